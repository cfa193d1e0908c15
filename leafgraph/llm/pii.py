"""Surrogates for personal data, with DataFrame functions only.

Found: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards (with a right check digit), IBANs (likewise),
US social security numbers, hexadecimal tokens of any length from 32 on, and people's names behind a title, behind words
that announce a name (CUES), or of a known given name and one more. Where a name was found, its words are replaced wherever
else they stand in the same text, alone or in capitals. Each value gets a surrogate of its own kind, made from a keyed hash
of the value: the same length, separators and country code, right check digits, the same script and case, names of the
same gender. One value has one surrogate in the whole table, however it is written, and two values never share one. No
surrogate is a value of its kind that occurs in the table. Where a form has too few values for all that occur, surrogates get longer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.session import cut, small_side

# Titles and given names that are known, by gender: a small lexicon, a parameter of what is found.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "г-жа"], "x": ["Dr", "Prof"]}
GIVEN = {
    ("f", "latin"): "Alice Ana Anna Barbara Camille Carmen Charlotte Claire Elena Elisabeth Elizabeth Emily Emma Françoise Gabriela Irina Isabel Jane Julia Katharina Laura Linda Lucía Margaret Maria María Marie Mary Monika Nathalie Olga Petra Sabine Sarah Sophie Susan Ursula".split(),
    ("m", "latin"): "Alexander Bernard Boris Carlos Christopher Daniel David Eduardo François George Hans Heinrich Henry Ivan Jacques James Jean John Jonathan José Juan Jürgen Klaus Ludwig Martin Michael Miguel Nicholas Paul Peter Pierre Robert Roberto Thomas William".split(),
    ("f", "cyrillic"): "Анна Екатерина Мария Наталья Ольга Татьяна".split(),
    ("m", "cyrillic"): "Александр Владимир Дмитрий Михаил Николай Сергей".split(),
}
#: Words right before a name, which stay as they are.
CUES = ["My name is", "my name is", "Name:", "name:", "Mein Name ist", "mein Name ist", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Mi nombre es", "mi nombre es", "Меня зовут", "меня зовут"]
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя"}
SYLLABLES = {"latin": "ba ce di fo gu ha ki lo mar nel por quin ras sol tam ver win xan yor zel".split(), "cyrillic": "ба ве ги до жу ка ли мо на пе ри со ту фа хе шо".split()}
ENDINGS = {"latin": {"F": "a", "M": "o", "X": "e"}, "cyrillic": {"F": "а", "M": "ов", "X": "е"}}

_WORD = r"\p{L}\p{N}"
_NAME = r"\p{Lu}(?:\p{L}|['’](?!s(?!\p{L}))(?=\p{L})|-(?=\p{L}))+"
#: Words that may stand where a name does without being part of one; they aren't looked for in the rest of a text.
COMMON = "a an and but das de der die ein eine el en er es he i ich il in it je la las le les los mit my no on she sie that the this und we wir y yo you".split()
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "|".join(t for group in TITLES.values() for t in group)
_KNOWN = "|".join(n for group in GIVEN.values() for n in group)
_CUE = "|".join(CUES)
#: Country codes of one and two digits; all others have three (fixed values of the numbering plan).
_LAND = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
# Forms that begin where no letter or digit stands before them, and forms that begin with a digit, a plus or a bracket.
AT_WORDS = [
    rf"(?<![._%+-])[{_WORD}._%+-]++@[{_WORD}-]++(?:\.[{_WORD}-]++)+",  # e-mail
    rf"[0-9a-fA-F]{{32,}}+(?![{_WORD}])",  # token
    rf"(?:(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}|(?:[0-9a-fA-F]{{1,4}}:){{1,6}}(?::[0-9a-fA-F]{{1,4}}){{1,6}})(?![{_WORD}:])",  # address
    rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_WORD}])",  # IBAN
    rf"(?=[\p{{Lu}}г])(?:(?:{_TITLE})\.?\s{_NAME}(?:\s{_NAME})?|(?:{_KNOWN})\s{_NAME}|(?<=(?<![{_WORD}])(?:{_CUE})\s){_NAME}(?:\s{_NAME})?)",  # name; some titles begin with г
]
AT_NUMBERS = [
    rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",  # address
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",  # social security number
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,8}){1,4}(?!\d)|\+\d{7,15}(?!\d)|(?<![\d.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\(0\d{2,4}\) ?\d{5,8}(?!\d)|(?<![\d.-])0\d{2,4}[ /-](?:\d{5,8}|\d{3,4}[ -]\d{3,5})(?![\d-])|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])",  # phone
    r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}|3\d{3}[ -]\d{6}[ -]\d{5})(?!\d)",  # card
]
#: All forms. Grouped by how they begin, since most places of a text begin none: two looks at a place then suffice.
ANY = rf"(?<![{_WORD}])(?:{'|'.join(AT_WORDS)})|(?=[\d+(])(?:{'|'.join(AT_NUMBERS)})"
#: A word that may be a name's other mention.
MENTION = rf"(?<![{_WORD}]){_NAME}"
#: A text without any of these has nothing to be found.
HINT = rf"[@0-9]|[0-9a-fA-F]{{32}}|[a-fA-F]::?[a-fA-F]|(?<![{_WORD}])(?=[\p{{Lu}}гjmnм])(?:(?:{_TITLE})\.?|{_KNOWN}|{_CUE})\s"


def _at(text: Column, i: Column) -> Column:
    return F.substr(text, i.cast("int"), F.lit(1))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _byte(seed: Column, i: Column) -> Column:
    """Byte i (from 0, around) of 64 in hex."""
    return F.conv(F.substr(seed, (i % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _join(chars: Column) -> Column:
    return F.array_join(chars, "")


def _luhn(digits: Column) -> Column:
    """The sum that a right card number makes a multiple of ten."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _mod97(text: Column) -> Column:
    """An IBAN's check sum: 1 for a right one whose first four letters stand at the end."""
    def step(a: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(n > 9, (a * 100 + n) % 97).otherwise((a * 10 + n) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _turned(iban: Column) -> Column:
    return F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4))


def kind_of(match: Column) -> Column:
    """The kind of a match of ANY; null for numbers that only look like one."""
    digits = F.regexp_replace(match, r"\D", "")
    return (
        F.when(match.contains("@"), "EMAIL")
        .when(match.rlike("^[0-9a-fA-F]{32,}$"), "TOKEN")
        .when(match.rlike("^[0-9a-fA-F]{1,4}:[0-9a-fA-F:]+$"), "IP6")
        .when(match.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), F.when(_mod97(_turned(F.replace(match, F.lit(" "), F.lit("")))) == 1, "IBAN"))
        .when(match.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "IP")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "SSN")
        .when(match.rlike(r"^\p{L}"), "NAME")
        .when(match.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$|^0\d{2,4}[ /-]\d"), "PHONE")
        .when(_luhn(digits) % 10 == 0, "CARD")
    )


def atoms_of(match: Column, kind: Column) -> Column:
    """What gets surrogates of its own: (kind, value in one way of writing, as written). A name is taken word by word."""
    one = F.struct(
        kind.alias("kind"),
        F.when(kind.isin("PHONE", "CARD", "SSN"), F.concat(F.when(match.startswith("+"), "+").otherwise(""), F.regexp_replace(match, r"\D", ""))).when(kind == "IBAN", F.replace(match, F.lit(" "), F.lit(""))).otherwise(F.lower(match)).alias("value"),
        match.alias("shown"),
    )
    words = F.split(match, r"\s")
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    gender = reduce(lambda c, g: c.when(title.isin(TITLES[g]), g.upper()), TITLES, F.when(F.lit(False), ""))

    def word(w: Column, i: Column) -> Column:
        known = F.coalesce(*[F.when(w.isin(names), f"GIVEN_{g.upper()}") for (g, _), names in GIVEN.items()])
        given = gender.isNotNull() & (i == 1) & (F.size(words) == 3)
        what = F.when((i == 0) & gender.isNotNull(), "TITLE").otherwise(F.coalesce(known, F.when(given, F.concat(F.lit("GIVEN_"), gender)).otherwise("SURNAME")))
        return F.struct(what.alias("kind"), F.lower(w).alias("value"), w.alias("shown"))

    return F.when(kind == "NAME", F.transform(words, word)).when(kind.isNotNull(), F.array(one)).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("kind"), match.alias("value"), match.alias("shown"))))


def core(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a value, in one way of writing; another one for each attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 512)
    digits = F.translate(seed, "abcdef", "012345")
    size = F.length(value)

    def like(text: Column, letters: str, offset: int = 0) -> Column:
        def char(c: Column, i: Column) -> Column:
            b = _byte(seed, i + offset)
            return (
                F.when(c.rlike("^[0-9]$"), (b % 10).cast("string"))
                .when(c.rlike(r"^\p{IsCyrillic}$"), _at(F.lit(LETTERS["cyrillic"]), b % len(LETTERS["cyrillic"]) + 1))
                .when(c.rlike(r"^\p{L}$"), _at(F.lit(letters), b % len(letters) + 1))
                .otherwise(c)
            )

        return _join(F.transform(F.split(text, ""), char))

    local, host = F.substring_index(value, "@", 1), F.substring_index(F.substring_index(value, "@", -1), ".", 1)
    longer = F.when(attempt >= 3, like(F.lit("aaaaaa"), LETTERS["latin"], 40)).otherwise("")  # where short forms run out
    email = F.concat(like(local, LETTERS["latin"]), longer, F.lit("@"), like(host, LETTERS["latin"], 29), F.lit(".example."), _pick(["com", "net", "org"], _byte(seed, F.lit(63))))
    body = F.concat(F.substring(value, 1, 1), F.substr(digits, F.lit(1), size - 2))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    bban = like(F.substring(value, 5, 99), LETTERS["latin"].upper())
    land = F.substring(value, 1, 2)
    iban = F.concat(land, F.lpad((98 - _mod97(F.concat(bban, land, F.lit("00")))).cast("string"), 2, "0"), bban)
    first = F.when(attempt >= 3, 1 + _byte(seed, F.lit(0)) % 254).otherwise(240 + _byte(seed, F.lit(0)) % 15)  # reserved addresses, while they last
    ip = F.concat_ws(".", first.cast("string"), *[_byte(seed, F.lit(i)).cast("string") for i in (1, 2, 3)])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 128).cast("int")), lambda i: F.when(i == 0, seed).otherwise(F.sha2(F.concat_ws("|", seed, i.cast("string")), 512)))
    token = F.substr(_join(blocks), F.lit(1), size)
    six = _join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), (_byte(seed, i) % 10).cast("string")).when(c.rlike("^[a-f]$"), _at(F.lit("abcdef"), _byte(seed, i) % 6 + 1)).otherwise(c)))

    def name(script: str) -> Column:
        own = SYLLABLES[script]
        stem = F.initcap(F.concat(*[_pick(own, _byte(seed, F.lit(i))) for i in range(4)], F.when(attempt >= 3, F.concat(*[_pick(own, _byte(seed, F.lit(i))) for i in range(4, 8)])).otherwise("")))
        return F.concat(stem, F.coalesce(*[F.when(kind == f"GIVEN_{g}", end) for g, end in ENDINGS[script].items()], F.lit("")))

    out = F.when(kind == "EMAIL", email).when(kind == "TOKEN", token).when(kind == "CARD", card).when(kind == "IBAN", iban).when(kind == "IP", ip).when(kind == "IP6", six)
    kept = F.when(value.startswith("+"), F.regexp_extract(value, rf"^\+(?:{_LAND})", 0)).otherwise(F.substring(value, 1, 1))
    more = F.when(attempt >= 8, F.substr(digits, F.lit(100), F.lit(4))).otherwise("")  # where all numbers of this length are taken
    out = out.when(kind == "PHONE", F.concat(kept, F.substr(digits, F.lit(1), size - F.length(kept)), more)).when(kind == "SSN", F.concat(F.lit("9"), F.substr(digits, F.lit(1), size - 1), more))
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    return out.when(kind.isin("SURNAME", "GIVEN_F", "GIVEN_M", "GIVEN_X"), F.when(cyrillic, name("cyrillic")).otherwise(name("latin")))


def written(kind: Column, surrogate: Column, shown: Column) -> Column:
    """The surrogate written as the value was: its separators, its case."""
    def fold(a: Column, c: Column) -> Column:
        taken = F.struct(F.concat(a["out"], _at(surrogate, a["k"])).alias("out"), (a["k"] + 1).alias("k"))
        return F.when(c.rlike("^[0-9A-Z]$"), taken).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))

    start = F.struct(F.lit("").alias("out"), F.when(surrogate.startswith("+"), 2).otherwise(1).alias("k"))
    spaced = F.aggregate(F.split(shown, ""), start, fold, lambda a: F.concat(a["out"], F.substr(surrogate, a["k"])))
    cased = F.when((shown == F.upper(shown)) & (shown != F.lower(shown)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isNull() | (kind == "TITLE"), shown).when(kind.isin("PHONE", "CARD", "SSN", "IBAN"), spaced).otherwise(cased)


def _matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def later_attempts(docs: DataFrame, key: str, max_rounds: int = 20, text_col: str = "text") -> DataFrame:
    """(kind, value, core) of the values whose first surrogate was taken: by another value's, or as a value of the table.

    Of values that share a surrogate the least keeps it; the others, and those whose surrogate occurs as a value, try
    again until all differ. A round compares the distinct values only. Usually nothing is left.
    """
    found = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike(HINT)).select(F.explode(_matches(F.col("text"))).alias("m"))
    atoms = found.select(F.explode(atoms_of(F.col("m"), kind_of(F.col("m")))).alias("a")).select("a.kind", "a.value")
    values = atoms.where("kind is not null and kind <> 'TITLE'").distinct().withColumn("attempt", F.lit(0))
    values = cut(values.withColumn("core", core(F.col("kind"), F.col("value"), F.col("attempt"), key)))
    real = values.select("kind", F.lower("value").alias("taken")).distinct()
    for _ in range(max_rounds):
        lower = values.withColumn("taken", F.lower("core"))
        shared = lower.groupBy("kind", "taken").agg(F.min("value").alias("keeper"), F.count("*").alias("n")).where("n > 1")
        losers = lower.join(shared, ["kind", "taken"]).where("value <> keeper").select("kind", "value")
        losers = losers.unionByName(lower.join(real, ["kind", "taken"], "left_semi").select("kind", "value")).distinct()
        losers = cut(losers.withColumn("again", F.lit(1)))
        if losers.isEmpty():
            return values.where("attempt > 0").select("kind", "value", "core")
        values = values.join(small_side(losers), ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        values = cut(values.select("kind", "value", "attempt", core(F.col("kind"), F.col("value"), F.col("attempt"), key).alias("core")))
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in its text, and columns pii_count int and pii_kinds (sorted kinds, comma-separated; names: NAME).

    pii_count counts what was found by its form; further mentions of a name that was found are replaced, not counted.

    Columns of docs named like the two new ones or beginning with __pii are left out; all others stay as they are. A null
    or empty text stays, with 0 and ''. Repeated rows get the same surrogates. `key` must be kept secret: whoever has it
    can test guesses. Texts are not shuffled, unless surrogates had to be tried again for too many values to broadcast.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("pii_count", "pii_kinds") or c.lower().startswith("__pii")])
    later = cut(later_attempts(docs, key, text_col=text_col))
    text = F.col(text_col)
    with_atoms = docs.withColumn("__pii_m", F.when(text.rlike(HINT), _matches(text)))
    with_atoms = with_atoms.withColumn("__pii_a", F.transform("__pii_m", lambda m: atoms_of(m, kind_of(m))))
    if later.isEmpty():
        with_atoms = with_atoms.withColumn("__pii_later", F.lit(None).cast("map<string,string>"))
    else:
        # What was tried again, by the text it stands in: joined to the text's digest, so that null and repeated ids don't matter.
        with_atoms = with_atoms.withColumn("__pii_text", F.when(F.size("__pii_m") > 0, F.sha2(text, 256)))
        flat = with_atoms.where("__pii_text is not null").select("__pii_text", F.explode(F.flatten("__pii_a")).alias("a")).select("__pii_text", "a.kind", "a.value").distinct()
        own = flat.join(small_side(later), ["kind", "value"]).groupBy("__pii_text").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "core"))).alias("__pii_later"))
        with_atoms = with_atoms.join(small_side(cut(own)), "__pii_text", "left").drop("__pii_text")

    def replaced(a: Column) -> Column:
        again = F.try_element_at(F.col("__pii_later"), F.concat_ws("|", a["kind"], a["value"]))
        return written(a["kind"], F.coalesce(again, core(a["kind"], a["value"], F.lit(0), key)), a["shown"])

    spaces = lambda m: F.regexp_extract_all(m, F.lit(r"\s"), F.lit(0))
    join_words = lambda m, parts: F.when(F.size(parts) == 1, F.element_at(parts, 1)).otherwise(_join(F.zip_with(parts, spaces(m), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))))
    new = F.zip_with("__pii_m", "__pii_a", lambda m, atoms: join_words(m, F.transform(atoms, replaced)))
    # The words of names that were found, wherever else they stand in the text.
    named = lambda a: (a["kind"].startswith("GIVEN") | (a["kind"] == "SURNAME")) & ~a["value"].isin(COMMON)
    with_atoms = with_atoms.withColumn("__pii_names", F.array_distinct(F.transform(F.filter(F.flatten("__pii_a"), named), lambda a: F.struct(a["kind"].alias("kind"), a["value"].alias("value")))))

    def mention(w: Column) -> Column:
        who = F.try_element_at(F.filter("__pii_names", lambda a: a["value"] == F.lower(w)), F.lit(1))
        return F.when(who.isNull(), w).otherwise(replaced({"kind": who["kind"], "value": who["value"], "shown": w}))

    def mentions(part: Column) -> Column:
        words = F.transform(F.regexp_extract_all(part, F.lit(MENTION), F.lit(0)), mention)
        return _join(F.zip_with(F.split(part, MENTION, -1), words, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))))

    parts = F.split(text, ANY, -1)
    parts = F.when(F.size("__pii_names") > 0, F.transform(parts, mentions)).otherwise(parts)
    whole = _join(F.zip_with(parts, new, lambda between, s: F.concat(between, F.coalesce(s, F.lit("")))))
    kinds = F.filter(F.transform("__pii_m", kind_of), lambda k: k.isNotNull())
    found = F.coalesce(F.size("__pii_m"), F.lit(0)) > 0
    columns = [F.when(found, whole).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return with_atoms.select(*columns, F.when(found, F.size(kinds)).otherwise(0).alias("pii_count"), F.when(found, F.array_join(F.array_sort(F.array_distinct(kinds)), ",")).otherwise("").alias("pii_kinds"))
