"""Personal data: detected entities give way to keyed surrogates of the same type, in DataFrame operations only.

One pattern finds the entities of a text; the text is split there and joined again with surrogates in their place, so that
nothing else changes. A surrogate derives from SHA-256 over key, type, attempt and the canonical entity: the same entity has the
same surrogate everywhere (coreference), in whatever case or punctuation it is written. Letters stay letters of their case and
script, digits stay digits and punctuation stays; e-mail addresses keep their top-level domain, phone numbers their country code,
card numbers their check-digit validity, addresses stay dotted quads, credentials keep the keyword before them and hexadecimal
stays hexadecimal, account numbers (IBAN) keep country and valid check digits; names keep title, gender (as far as the title tells)
and script.

Persons are found by a title. One person has one surrogate under all titles of a gender, and in a document that names a person with a
title, the names alone (``Smith``, ``John Smith``) and the title with the family name alone get the same surrogate names; where two
persons of a document share a name, the first one named in full has it.

Collision checks: over all distinct entities of the table, no two of a type may share a surrogate and no surrogate may be an
entity that occurs. Losers take their next attempt until none is left (``ROUNDS`` at most, then it is an error); the few entities with later attempts
reach their documents by a join that is left out when there are none.

The key is secret: who has it can tell surrogates by trying entities. Sessions set it as ``spark.lumberline.pii.key``; the key in
this file is for tests.

Limits: phone numbers without a country code are found in the form of three, three and four digits only; secrets need a keyword
before them, and four letters or digits (after a colon and without quotes also eight characters or a digit).

Defined cases: a null text stays null (and counts no entity), an empty one empty; repeated rows get equal results; an empty table
gives an empty result; n_entities counts what the pattern finds, not names without a title; other columns are ignored by ``surrogates`` and kept by ``anonymised``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import pick, stored

KEY = "lumberline"
KEY_SETTING = "spark.lumberline.pii.key"
ROUNDS = 64
# Words that name a credential, titles by gender, first names by gender and script.
CREDENTIALS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key")
MALE_TITLES = ("Mr.", "Mister", "Herr", "Monsieur", "Señor", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs.", "Ms.", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr.", "Prof.", "Doctor", "Professor")
MALE_NAMES = {"Latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan"), "Cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Максим", "Олег", "Павел"), "Greek": ("Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος")}
FEMALE_NAMES = {"Latin": ("Alma", "Bella", "Clara", "Dora", "Emma", "Flora", "Hanna", "Irma"), "Cyrillic": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"), "Greek": ("Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία")}
SYLLABLES = {"Latin": ("ba", "de", "lo", "mi", "nu", "ra", "so", "ve", "ka", "ti", "go", "fe", "pu", "ly", "wo", "ze"), "Cyrillic": ("ба", "де", "ло", "ми", "ну", "ра", "со", "ве", "ка", "ти", "го", "фе", "пу", "лы", "во", "зе"), "Greek": ("βα", "δε", "λο", "μι", "νυ", "ρα", "σο", "βε", "κα", "τι", "γο", "φε", "πυ", "λη", "ωρ", "ζε")}

#: Labels with their dots. Where the domain's last dot ends a sentence, it is given back; names have 127 labels at most.
_LABEL = r"(?:[A-Za-z0-9-]++\.)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
TITLES = (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)
_TITLES = "|".join(x.replace(".", r"\.") for x in TITLES)
#: Of a secret at least four characters must be of a kind that a surrogate moves; with fewer there are too few surrogates.
_MOVES = r"[A-Za-z0-9а-яА-Я\u4E00-\u9C1F\uAC00-\uD6F7]"
_SECRET = rf"[^\s\"']{{3,}}(?<=[\p{{L}}\p{{N}}+/_-])"
#: After the keyword: a value in quotes; any run without blanks after '='; after ':' one of eight characters, or with a digit.
_QUOTED = r"(?::?=>?|:)\s{0,3}+(?:" + "|".join(rf"{q}(?=(?:[^{q}\r\n]*?{_MOVES}){{4}})[^{q}\r\n]{{4,128}}(?={q}|$)" for q in ('"', "'")) + ")"
_ASSIGNED = rf":?=>?\s{{0,3}}+[\"']?(?=(?:[^\s\"']*?{_MOVES}){{4}}){_SECRET}"
_TOLD = rf":\s{{0,3}}+[\"']?(?=[^\s\"']*?[0-9]|[^\s\"']{{8}})(?=(?:[^\s\"']*?{_MOVES}){{4}}){_SECRET}"
_GROUPED = r"(?:[ /-]\(\d{1,5}\)|[ /-]?\(\d{1,5}\)|[ /-]\d{1,12})"
#: International numbers with any groups, or none: a country code and at least seven digits in all.
_ABROAD = rf"(?<!\+)\+(?=[1-9](?:[ /()-]{{0,2}}\d){{6}})(?:\d{{7,15}}|\d{{1,3}}{_GROUPED}{{1,6}}(?:(?<=\))[ /-]?\d{{1,12}}{_GROUPED}{{0,6}})?)(?!\w|\.\d)|(?<!\+)\+(?=[1-9](?:\.?\d){{6}})\d{{1,3}}(?:\.\d{{1,6}}){{2,6}}(?!\w|\.\d)"
#: National numbers of three, three and four digits with dots or blanks.
_NATIONAL = r"(?<!\.)\d{3}\.\d{3}\.\d{4}(?!\w|[.-]\d)|\(\d{3}\)[ .]?\d{3}[ .-]\d{4}(?!\w)|[2-9]\d{2} \d{3} \d{4}(?!\w)|[2-9]\d{2} \d{3}-\d{4}(?!\w)"
PATTERNS = {
    "email": rf"(?<![.%+-])[A-Za-z0-9._%+-]++@(?:{_LABEL}++[A-Za-z]{{2,}}|{_LABEL}{{1,126}}[A-Za-z]{{2,}})",
    "credential": rf"(?i:{'|'.join(CREDENTIALS)})[\"']?\s{{0,3}}+(?:{_QUOTED}|{_ASSIGNED}|{_TOLD})",
    "cloud_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "phone": r"(?<!\+)\+\d{1,3} ?\(\d{2,4}\) ?\d{3,4}[ -]?\d{4}(?!\w)|(?<!\+)\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\w)|\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<!-)\d{3}-\d{3}-\d{4}(?![\w-])"
    + f"|{_ABROAD}|{_NATIONAL}",
    "social": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w)",
    "address": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "account": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "person": rf"(?:{_TITLES}) \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?",
}
_TITLE_LETTERS = "".join(sorted({x[0] for x in TITLES}))
_NUMBERS = "|".join(PATTERNS[x] for x in ("phone", "social", "card", "address"))
#: But for credentials (DB_PASSWORD=) no entity begins inside a word: that test comes first, and most characters fail it. The first
#: character picks the branch.
PATTERN = rf"(?<![A-Za-z0-9_])(?:(?=[0-9+(])(?:{_NUMBERS})|(?=[{_TITLE_LETTERS}]){PATTERNS['person']}|(?=A){PATTERNS['cloud_key']}|(?=[A-Z]{{2}}[0-9]){PATTERNS['account']}|(?=[0-9A-Fa-f]{{1,4}}:){PATTERNS['address6']}|{PATTERNS['email']})|(?=[apstAPST]){PATTERNS['credential']}"
#: Without one of these or a title a text has no entity.
HINT = "[0-9@=:]"
_KEYWORD = rf"^(?i:{'|'.join(CREDENTIALS)})[\"']?\s*(?::?=>?|:)\s*[\"']?"
#: Country codes; a compact number begins with one of them.
_CODE = r"^\+(\d{1,3}(?!\d)|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Letters move within their block, by case: first letter, number of letters.
BLOCKS = ((97, 26), (65, 26), (0x430, 32), (0x410, 32), (0x3B1, 17), (0x391, 17), (0x4E00, 20000), (0x3041, 80), (0xAC00, 11000), (0x5D0, 27), (0x621, 26))


def _all(text: Column) -> Column:
    hint = reduce(lambda a, b: a | b, (text.contains(x) for x in TITLES), text.rlike(HINT))
    return F.when(hint, F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def kind(entity: Column) -> Column:
    tests = [(F.lit(name), entity.rlike(f"^(?:{p})$")) for name, p in PATTERNS.items()]
    return reduce(lambda rest, t: F.when(t[1], t[0]).otherwise(rest), reversed(tests), F.lit("other"))


def _gender(title: Column) -> Column:
    return F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f").otherwise("n")


def canonical(entity: Column, kind: Column) -> Column:
    """What two spellings of an entity share."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind.isin("phone", "social", "card"), digits).when(kind == "email", F.lower(entity)).when(kind == "credential", F.lower(F.regexp_replace(entity, _KEYWORD, ""))).when(kind == "account", F.regexp_replace(entity, " ", "")).when(kind == "address6", F.lower(entity)).when(kind == "person", F.concat(_gender(F.substring_index(entity, " ", 1)), F.regexp_replace(entity, r"^\S+", ""))).otherwise(entity)


def _byte(stream: Column, i: Column) -> Column:
    """Number i of the stream: 16 bits of it."""
    return F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _stream(seed: Column, n: Column) -> Column:
    """Hexadecimal digits for n numbers or more: 16 numbers a block."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 256)), "")


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _moved(c: Column, at: Column, v: Column) -> Column:
    """A character of the same block, case and kind; at: its code point."""
    out = F.when(c.rlike("^[0-9]$"), (at - 48 + v) % 10 + 48)
    for first, n in BLOCKS:
        out = out.when(at.between(first, first + n - 1), (at - first + v) % n + first)
    code = out.when(F.lower(c) != c, v % 26 + 65).when(F.upper(c) != c, v % 26 + 97)
    return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "utf-16be"), c)


def _shifted(text: Column, stream: Column) -> Column:
    """Each character moved by its own number; at least by one where the block has more than one."""
    each = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), F.ascii(c).alias("at"), (1 + _byte(stream, i) % 9).alias("v")))
    return F.array_join(F.transform(each, lambda x: _moved(x["c"], x["at"], x["v"])), "")


def _hexadecimal(text: Column, stream: Column) -> Column:
    moved = F.transform(F.split(text, ""), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex((F.conv(c, 16, 10).cast("int") + 1 + _byte(stream, i) % 15) % 16))))
    plain = F.array_join(moved, "")
    return F.when(text == F.upper(text), F.upper(plain)).otherwise(plain)


def _digits(digits: Column, stream: Column, keep: Column) -> Column:
    """Digits moved but for the first ``keep``."""
    return F.array_join(F.transform(F.split(digits, ""), lambda c, i: F.when(i < keep, c).otherwise(((c.cast("int") + 1 + _byte(stream, i) % 9) % 10).cast("string"))), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule, mod 10."""
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))), F.lit(0), lambda a, x: a + x) % 10


def _checked(digits: Column, moved: Column) -> Column:
    """A card number keeps the validity of its check digit."""
    stem = moved.substr(F.lit(1), F.length(moved) - 1)
    right = ((10 - _luhn(F.concat(stem, F.lit("0")))) % 10).cast("int")
    last = moved.substr(F.length(moved), F.lit(1)).cast("int")
    wrong = F.when(last == right, (last + 1) % 10).otherwise(last)
    return F.concat(stem, F.when(_luhn(digits) == 0, right).otherwise(wrong).cast("string"))


def _filled(form: Column, digits: Column) -> Column:
    """The digits in the places of the form's digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(digit, digits.substr(acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["out"])


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(text.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def _list(by_script: dict[str, tuple[str, ...]], script: Column) -> Column:
    arrays = {k: F.array(*map(F.lit, v)) for k, v in by_script.items()}
    return F.when(script == "Cyrillic", arrays["Cyrillic"]).when(script == "Greek", arrays["Greek"]).otherwise(arrays["Latin"])


def _person(entity: Column, stream: Column) -> Column:
    """Title kept; a first name of its gender where there are two names; a family name of syllables in the same script."""
    script = _script(F.regexp_replace(entity, r"^\S+ ", ""))
    parts = F.split(entity, " ")
    gender = _gender(parts[0])
    female = (gender == "f") | (gender == "n") & (_byte(stream, F.lit(7)) % 2 == 0)
    first = F.when(female, F.element_at(_list(FEMALE_NAMES, script), 1 + _byte(stream, F.lit(0)) % 8)).otherwise(F.element_at(_list(MALE_NAMES, script), 1 + _byte(stream, F.lit(0)) % 8))
    syllables = _list(SYLLABLES, script)
    family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.element_at(syllables, 1 + _byte(stream, i) % 16)), ""))
    return F.when(F.size(parts) > 2, F.concat_ws(" ", parts[0], first, family)).otherwise(F.concat_ws(" ", parts[0], family))


def _account(entity: Column, stream: Column) -> Column:
    """Country kept, the rest moved, check digits that fit (the number, turned by four, is 1 modulo 97)."""
    country, bare = F.left(entity, F.lit(2)), F.regexp_replace(entity, " ", "")

    def rest(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    def checked(body: Column) -> Column:
        check = F.lpad((98 - F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), rest)).cast("string"), 2, "0")
        letters = F.split(F.concat(country, check, body), "")
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
        put = lambda acc, c: F.struct(F.concat(acc["out"], F.when(c == " ", c).otherwise(F.element_at(letters, acc["k"]))).alias("out"), (acc["k"] + (c != " ").cast("int")).alias("k"))
        return F.aggregate(F.split(entity, ""), start, put, lambda acc: acc["out"])

    return _bound(_shifted(bare.substr(F.lit(5), F.length(bare)), stream), checked)


def _made(x: Column) -> Column:
    """x: entity, kind and stream."""
    entity, kind, stream = x["entity"], x["kind"], x["stream"]
    digits = F.regexp_replace(entity, "[^0-9]", "")
    code = F.when(entity.startswith("+"), F.length(F.regexp_extract(entity, _CODE, 1))).otherwise(0)
    top = F.regexp_extract(entity, r"\.[A-Za-z]{2,}$", 0)
    body = F.regexp_replace(entity, _KEYWORD, "")
    card = _bound(F.struct(digits.alias("old"), _digits(digits, stream, F.lit(0)).alias("new")), lambda d: _checked(d["old"], d["new"]))
    octets = F.transform(F.split(entity, r"\."), lambda o, i: ((o.cast("int") + 1 + _byte(stream, i) % 254) % 255).cast("string"))
    return (
        F.when(kind == "email", F.concat(_shifted(entity.substr(F.lit(1), F.length(entity) - F.length(top)), stream), top))
        .when(kind == "credential", F.concat(F.regexp_extract(entity, _KEYWORD, 0), F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), _hexadecimal(body, stream)).otherwise(_shifted(body, stream))))
        .when(kind == "cloud_key", F.concat(F.left(entity, F.lit(4)), _shifted(entity.substr(F.lit(5), F.lit(16)), stream)))
        .when(kind == "phone", _filled(entity, _digits(digits, stream, code)))
        .when(kind == "social", _filled(entity, _digits(digits, stream, F.lit(0))))
        .when(kind == "card", _filled(entity, card))
        .when(kind == "address", F.array_join(octets, "."))
        .when(kind == "person", _person(entity, stream))
        .when(kind == "account", _account(entity, stream))
        .when(kind == "address6", _hexadecimal(entity, stream))
        .otherwise(_shifted(entity, stream))
    )


def surrogate(found: Column, key: str = KEY) -> Column:
    """The surrogates of an array of (entity, attempt); each step binds what the next uses, so that it is computed once."""
    kinds = F.transform(found, lambda x: F.struct(x["entity"].alias("entity"), x["attempt"].alias("attempt"), kind(x["entity"]).alias("kind")))
    seeds = F.transform(kinds, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), F.concat_ws("\x1f", F.lit(key), x["kind"], x["attempt"].cast("string"), canonical(x["entity"], x["kind"])).alias("seed")))
    streams = F.transform(seeds, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), _stream(x["seed"], F.length(x["entity"])).alias("stream")))
    return F.transform(streams, _made)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct type and canonical form of all entities, with one spelling of each."""
    found = pick(docs, "text").select(F.explode(F.array_distinct(_all(F.col("text")))).alias("entity"))
    named = found.distinct().withColumn("kind", kind(F.col("entity")))
    return named.withColumn("own", canonical(F.col("entity"), F.col("kind"))).groupBy("kind", "own").agg(F.min("entity").alias("entity"))


def later_attempts(docs: DataFrame, key: str = KEY) -> DataFrame | None:
    """kind, own and attempt of the entities whose first surrogate is taken; None if there are none."""
    known = stored(entities(docs).withColumn("attempt", F.lit(0)), "entities")
    for _ in range(ROUNDS):
        made = known.withColumn("new", surrogate(F.array(F.struct("entity", "attempt")), key)[0])
        made = stored(made.withColumn("made", canonical(F.col("new"), F.col("kind"))).drop("new"), "surrogates")
        taken = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "own")).alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        losers = made.join(taken, ["kind", "made"]).where(F.struct("attempt", "own") != F.col("winner")).select("kind", "own")
        real = made.select("kind", "own", "made").join(known.select("kind", F.col("own").alias("made")), ["kind", "made"], "left_semi").select("kind", "own")
        again = stored(losers.unionByName(real).distinct(), "losers")
        if again.isEmpty():
            late = known.where("attempt > 0").select("kind", "own", "attempt")
            return None if late.isEmpty() else late
        known = stored(known.join(again.withColumn("more", F.lit(1)), ["kind", "own"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more"), "entities")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} attempts")


_WORDS = r"(?<!\p{L})(?=\p{L})|(?<=\p{L})(?!\p{L})"


def _names(found: Column, made: Column) -> Column:
    """A document's names and their surrogates, as a map; those of persons named in full come first."""
    pairs = F.filter(F.zip_with(found, made, lambda a, b: F.struct(F.split(a["entity"], " ").alias("old"), F.split(b, " ").alias("new"))), lambda p: p["old"][0].isin(*TITLES))
    both = lambda i, p: F.struct(p["old"][i].alias("name"), p["new"][i].alias("to"))
    size = lambda n: F.filter(pairs, lambda p: F.size(p["old"]) == n)
    told = F.concat(F.transform(size(3), lambda p: both(2, p)), F.transform(size(3), lambda p: both(1, p)), F.transform(size(2), lambda p: both(1, p)))

    def mapped(told: Column) -> Column:
        keys = F.array_distinct(F.transform(told, lambda n: n["name"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(told, lambda n: n["name"] == k)[0]["to"]))

    return _bound(told, mapped)


def _joined(x: Column) -> Column:
    """x: gaps, found and made. The text again, with surrogates in place of entities and of names that stand without a title."""
    plain = lambda made: F.array_join(F.flatten(F.zip_with(x["gaps"], F.concat(made, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")

    def named(names: Column) -> Column:
        told = lambda word: F.coalesce(F.try_element_at(names, word), word)
        gaps = F.transform(x["gaps"], lambda g: F.array_join(F.transform(F.split(g, _WORDS), told), ""))
        alone = lambda a, b: F.when(a["entity"].rlike(rf"^(?:{_TITLES}) \S+$"), F.concat_ws(" ", F.substring_index(a["entity"], " ", 1), told(F.substring_index(a["entity"], " ", -1)))).otherwise(b)
        made = F.zip_with(x["found"], x["made"], alone)
        return F.array_join(F.flatten(F.zip_with(gaps, F.concat(made, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")

    person = F.exists(x["found"], lambda e: e["entity"].rlike(rf"^(?:{_TITLES}) "))
    return F.when(person, _bound(_names(x["found"], x["made"]), named)).otherwise(plain(x["made"]))


def _rewritten(rows: DataFrame, late: DataFrame | None, key: str) -> DataFrame:
    """rows: row, text and others; adds found (the entities) and clean (the text with surrogates)."""
    rows = rows.withColumn("found", _all(F.col("text")))
    if late is None:
        rows = rows.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        each = rows.select("row", F.explode(F.array_distinct("found")).alias("entity")).withColumn("kind", kind(F.col("entity")))
        each = each.withColumn("own", canonical(F.col("entity"), F.col("kind"))).join(late, ["kind", "own"])
        pairs = each.select("row", "entity", "attempt").distinct()  # at most the entities of one row
        rows = rows.join(pairs.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("attempts")), "row", "left")

    found = F.transform("found", lambda e: F.struct(e.alias("entity"), F.coalesce(F.try_element_at("attempts", e), F.lit(0)).alias("attempt")))
    parts = F.transform(F.array(F.struct(F.split("text", PATTERN, -1).alias("gaps"), found.alias("found"))), lambda x: F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), surrogate(x["found"], key).alias("made")))[0]
    joined = _bound(parts, _joined)
    return rows.withColumn("clean", F.when(F.size("found") > 0, joined).otherwise(F.col("text")))


def secret(spark: SparkSession) -> str:
    """The key of the session."""
    return spark.conf.get(KEY_SETTING, KEY)


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates, and n_entities of every row."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.struct("doc_id", F.xxhash64("text")))
    return _rewritten(rows, later_attempts(docs, key), key).select("doc_id", F.col("clean").alias("text"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_entities"))


def anonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All rows and columns, with surrogates in text; n_chars, if there, counts the new text."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index("text")
    rows = plain.withColumn("text", F.col(f"c{at}")).withColumn("row", F.struct(F.col(f"c{names.index('doc_id')}"), F.xxhash64("text")))
    done = _rewritten(rows, later_attempts(docs, key), key)
    same = {f"c{at}": F.col("clean")}
    if "n_chars" in names:
        c = f"c{names.index('n_chars')}"
        same[c] = F.when(F.size("found") > 0, F.char_length("clean").cast(plain.schema[c].dataType)).otherwise(F.col(c))
    return done.withColumns(same).select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)
