"""Personal data replaced by keyed surrogates of the same type and format; DataFrame functions only.

One pattern cuts a text into entities and what lies between them. Each entity has
parts with a type and a canonical form (an address in lower case, a number's
digits, each word of a name). A part's surrogate is drawn from SHA-256 over the
secret key, type, form and an attempt. Over the table of all distinct parts,
surrogates that meet another one or a form that really occurs are drawn again
until none do: distinct entities stay distinct, and no surrogate is somebody
else's data. Draws after the third are longer than the original, so that even a
type whose forms are all taken settles.

A word of a name is one person's whatever its honorific: its ending follows the
honorifics that it has anywhere in the table (female, male, or neither where
they differ). In a document with names, their words are also replaced where they
stand alone, capitalised. The occurrence's own format (signs, spaces, case,
script, honorific, particles, initials) is put on. Cards end in a valid check
digit, IBANs keep country, letters and valid check digits.

Only documents that pass a cheap gate (a digit, an @, an honorific, a key's
prefix) meet the pattern, once, and their pieces are stored; only those with entities are shuffled. A mail address keeps the kinds
and script of its characters before the @, and addresses of one host share one; private and loopback addresses stay such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchlake.llm.runtime import checkpoint, store

#: Honorifics, also in upper case, by gender; words of names that stay; words that end a name.
FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Madame", "Frau", "Señora", "Sra", "Г-жа", "Κα")
MALE = ("Mr", "Monsieur", "Herr", "Señor", "Sr", "Г-н", "Κος")
NEUTRAL = (r"Dr\.-Ing", "Dr", "Prof")
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "las", "los", "bin", "ibn", "al", "el", "ter", "zu", "zur")
NO_NAMES = ("The", "A", "An", "And", "Or", "But", "In", "On", "At", "Of", "For", "He", "She", "It", "Der", "Die", "Das", "Und", "El", "La", "Los", "Las", "Le", "Les", "Et", "Y", "I")
#: Of these, words that are also surnames; right after an honorific they are names, but nowhere else in the document.
SURNAMES = ("An", "Das", "He", "Le", "La", "She")
#: Parts of an entity's text that say what a secret is.
_LABEL = r"(?i:passw(?:or)?d|pwd|secret|api[_-]?key|access[_-]?key|token)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
_PREFIX = "AKIA|ASIA|ghp_|gho_|ghs_|xox[bap]-|sk-"
#: Salts of a text's key, so that copies of one text are many groups.
SALTS = 64


def _either(words: tuple[str, ...]) -> str:
    return "|".join(dict.fromkeys(x for w in words for x in (w, w.upper())))


_HONORIFIC = _either(FEMALE + MALE + NEUTRAL)
_LETTER, _PART = r"[\p{L}\p{M}]", "|".join(PARTICLES)
#: A space or two, or the end of a line, within a name.
_GAP = r"(?:[ \u00a0]{1,2}|[ \t]?\r?\n[ \t]?)"
_INITIAL, _CAPITALISED = r"\p{Lu}\.", rf"\p{{Lu}}{_LETTER}*+(?:['’-]{_LETTER}++)*+"
_WORD = rf"(?:{_INITIAL}|(?!(?:{'|'.join(NO_NAMES)}|{_HONORIFIC})(?!{_LETTER}|['’-])){_CAPITALISED})"
_AFTER_HONORIFIC = rf"(?:{_WORD}|(?:{'|'.join(SURNAMES)})(?!{_LETTER}|['’-]))"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_H16 = "[0-9A-Fa-f]{1,4}"
#: Kinds of entities, by falling precedence; no pattern has a capturing group.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,126}\p{L}{2,}+",
    "ip6": rf"(?<![\p{{L}}\d:.])(?:(?:{_H16}:){{7}}{_H16}|(?=[A-Fa-f:]*\d)(?:(?:{_H16}:){{1,6}}|:)(?::{_H16}){{1,6}})(?![\p{{L}}\d:])",
    "ip": rf"(?<![\p{{L}}\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d+./-])(?<!\d )0\d{2,4}[ /-]\d{5,8}(?![\d./-]| \d)",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])|(?<![\p{L}\d])[a-z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,3})?(?![\p{L}\d])",
    "ssn": r"(?<![\d-])(?<!\d )(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\d-]| \d)",
    "secret": rf"(?<![\p{{L}}\d])(?:(?=[a-f]*\d)[0-9a-f]{{32,}}+|(?=[A-F]*\d)[0-9A-F]{{32,}}+)(?![\p{{L}}\d])|(?<![\p{{L}}\d])(?:{_PREFIX})[A-Za-z0-9_-]{{16,}}+",
    "card": r"(?<![\d])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|3\d{3}[ -]\d{6}[ -]\d{5})(?!\d)",
    "labelled": rf"(?<![\p{{L}}\d])(?:{_LABEL})(?:(?<=[wW].{{0,10}})|(?=[^\s\"',;<>]{{0,40}}\d)(?=[^\s\"',;<>]{{8}}))[^\s\"',;<>]{{4,}}+",
    "name": rf"(?<![\p{{L}}\d])(?:{_HONORIFIC})\.?{_GAP}(?:(?:{_PART}){_GAP}){{0,3}}{_AFTER_HONORIFIC}(?:{_GAP}(?:(?:{_PART}){_GAP}){{0,3}}{_WORD})*+(?!{_LETTER})",
}
PATTERN = "|".join(PATTERNS.values())
#: Every text with an entity has a digit, an @, an honorific, a key's prefix or a password's label. One class of first characters
#: decides for most characters of most texts, so that the gate is cheap; what begins with a usual letter is searched for plainly.
_FIRST = "".join(sorted({w[0] for w in _HONORIFIC.split("|")}))
_GATE = rf"[0-9@A{_FIRST}](?:(?<=[0-9@])|(?<=A)(?:KIA|SIA)|(?<=(?<!\p{{L}})[{_FIRST}])(?:{'|'.join(w[1:] for w in _HONORIFIC.split('|'))})\.?[ \t\r\n\u00a0])"
_MARKS = ("ghp_", "gho_", "ghs_", "xox", "sk-", "assw", "ASSW", "pwd", "PWD", "Pwd")
#: What marks the ends of entities in a text, and what follows the first character of it where the text has that itself.
_EDGE, _OWN = "\uffff\ufdd0", "\ufffe"


def gate(text: Column) -> Column:
    """Whether a text may have an entity."""
    out = text.rlike(_GATE)
    for mark in _MARKS:
        out = out | text.contains(mark)
    return out


def cut(text: Column) -> Column:
    """The pieces of a text: what lies between entities at even places, entities at odd ones."""
    marked = F.regexp_replace(F.replace(text, F.lit(_EDGE[0]), F.lit(_EDGE[0] + _OWN)), f"(?:{PATTERN})", f"{_EDGE}$0{_EDGE}")
    return F.transform(F.split(marked, _EDGE, -1), lambda p: F.replace(p, F.lit(_EDGE[0] + _OWN), F.lit(_EDGE[0])))


def kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(rf"\A(?:{pattern})\z"), "secret" if name == "labelled" else "ip" if name == "ip6" else name).otherwise(out)
    return out


def value(entity: Column) -> Column:
    """A secret without its label."""
    return F.regexp_replace(entity, rf"\A(?:{_LABEL})", "")


def name_words(entity: Column) -> Column:
    """The words of a name that are replaced, in lower case: neither honorific, particles nor single letters."""
    own = F.regexp_replace(entity, rf"\A(?:{_HONORIFIC})\.?{_GAP}", "")
    words = F.transform(F.regexp_extract_all(own, F.lit(rf"{_LETTER}+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*PARTICLES))


def parts(entity: Column) -> Column:
    """The parts of an entity, as an array of structs (type, form, gender)."""
    one = lambda name, form: F.array(F.struct(F.lit(name).alias("type"), form.alias("form"), F.lit(None).cast("string").alias("gender")))
    gender = F.when(entity.rlike(rf"\A(?:{_either(FEMALE)})\b"), "f").when(entity.rlike(rf"\A(?:{_either(MALE)})\b"), "m")
    words = name_words(entity)
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "name_cyrillic").when(w.rlike(r"\p{IsGreek}"), "name_greek").otherwise("name_latin")
    # only the first of several words is a given one
    named = F.transform(words, lambda w, i: F.struct(script(w).alias("type"), w.alias("form"), F.when((i == 0) & (F.size(words) > 1), F.coalesce(gender, F.lit("n"))).alias("gender")))
    digits = F.regexp_replace(entity, r"\D", "")
    secret = value(entity)
    sort = kind(entity)
    mail = F.array(F.lower(entity), F.regexp_extract(F.lower(entity), "@(.*)", 1))
    return (
        F.when(sort == "email", F.transform(mail, lambda f, i: F.struct(F.when(i == 0, "email").otherwise("host").alias("type"), f.alias("form"), F.lit(None).cast("string").alias("gender"))))
        .when(sort == "ip", one("ip", F.lower(entity)))
        .when(sort.isin("phone", "ssn", "card"), F.transform(F.array(sort), lambda s: F.struct(s.alias("type"), digits.alias("form"), F.lit(None).cast("string").alias("gender"))))
        .when(sort == "iban", one("iban", F.upper(F.regexp_replace(entity, " ", ""))))
        .when(sort == "name", named)
        .otherwise(one("secret", F.when(secret.rlike(r"\A(?:[0-9a-f]{32,}|[0-9A-F]{32,})\z"), F.lower(secret)).otherwise(secret)))
    )


def _sum(of: Column) -> Column:
    return F.aggregate(of, F.lit(0), lambda s, v: s + v)


def with_luhn(digits: Column) -> Column:
    """The digits and their check digit."""
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: (F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)))
    return F.concat(digits, ((10 - _sum(F.transform(doubled, lambda v: F.when(v > 9, v - 9).otherwise(v))) % 10) % 10).cast("string"))


def with_iban_check(country: Column, account: Column) -> Column:
    """Country, check digits and account."""
    whole = F.concat(account, country, F.lit("00"))
    figures = F.transform(F.sequence(F.lit(1), F.length(whole)), lambda i: F.conv(F.substr(whole, i, F.lit(1)), 36, 10).cast("int"))
    rest = F.aggregate(figures, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _like(form: Column, hexes: Column) -> Column:
    """Keyed letters and digits of the same kinds as the form's; other characters stay."""
    def one(i: Column) -> Column:
        c, h = F.substr(form, i, F.lit(1)), F.substr(hexes, i % 128 + 1, F.lit(1))
        letter = F.translate(h, "0123456789abcdef", "aeioulnrstmdgkbv")
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), F.translate(letter, "aeioulnrstmdgkbv", "аеиоулнрстмдгкбв")).when(c.rlike(r"\p{IsGreek}"), F.translate(letter, "aeioulnrstmdgkbv", "αειουλνρστμδγκβφ")).otherwise(letter)
        return F.when(c.rlike("[0-9]"), F.translate(h, "abcdef", "012345")).when(c.rlike(r"\p{Ll}"), letter).when(c.rlike(r"\p{L}"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.when(F.length(form) > 0, F.sequence(F.lit(1), F.length(form))).otherwise(F.array().cast("array<int>")), one), "")


def draw(key: str, kind_: Column, form: Column, attempt: Column, gender: Column | None = None) -> Column:
    """The canonical form of a surrogate."""
    gender = F.lit(None).cast("string") if gender is None else gender
    seed = F.concat_ws("\x1f", F.lit(key), kind_, form, attempt.cast("string"), F.lit(""))
    hexes = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f+")), 256))
    digits = F.translate(hexes, "abcdef", "012345")
    letters = F.translate(hexes, "0123456789abcdef", "aeioulnrstmdgkbv")
    longer = F.least(F.greatest(attempt - 3, F.lit(0)), F.lit(40))  # characters beyond the form's own
    octet = lambda i: (F.conv(F.substring(hexes, 4 * i + 1, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    group = lambda i: F.substring(hexes, 4 * i + 1, 4)
    number = lambda i: F.conv(F.substring(hexes, 4 * i + 1, 4), 16, 10).cast("int")
    # private, loopback and link-local addresses stay so; others get a first number that is none of these
    first = (
        F.when(form.startswith("10."), "10").when(form.startswith("127."), "127").when(form.startswith("192.168."), "192.168").when(form.startswith("169.254."), "169.254")
        .when(form.rlike(r"\A172\.(?:1[6-9]|2\d|3[01])\."), F.concat(F.lit("172."), (number(1) % 16 + 16).cast("string"))).otherwise((number(0) % 115 + 11).cast("string"))
    )
    octets = F.concat_ws(".", first, F.when(~first.contains("."), octet(1)), octet(2), octet(3), F.when(longer > 8, octet(4)))
    syllables = F.concat(*[F.concat(F.translate(F.substring(hexes, i, 1), "0123456789abcdef", "bdfgklmnprstvzch"), F.translate(F.substring(hexes, i + 1, 1), "0123456789abcdef", "aeiouaeioaeioaei")) for i in (1, 3, 5)])
    more = F.when(attempt > 0, F.substring(letters, F.lit(20), F.least(attempt, F.lit(40)))).otherwise("")
    latin = F.concat(syllables, more, F.when(gender == "f", "na").when(gender == "m", "r").when(gender == "n", "el").otherwise("n"))
    name = (
        F.when(kind_.endswith("cyrillic"), F.translate(latin, "abcdefghiklmnoprstuvz", "абцдефгхиклмнопрстувз"))
        .when(kind_.endswith("greek"), F.translate(latin, "abcdefghiklmnoprstuvz", "αβχδεφγηικλμνοπρστυυζ"))
        .otherwise(latin)
    )
    n = F.length(form)
    prefix = F.regexp_extract(form, rf"\A(?:{_PREFIX})?", 0)
    rest = F.substr(form, F.length(prefix) + 1, n)
    whole = F.repeat(hexes, F.ceil((n + longer) / 128).cast("int"))
    return (
        F.when(kind_ == "email", F.concat(_like(F.substring_index(form, "@", 1), hexes), F.substring(letters, F.lit(70), longer)))
        .when(kind_ == "host", F.concat(_like(F.substring_index(form, ".", 1), hexes), F.substring(letters, F.lit(70), F.least(attempt, F.lit(40))), F.lit(".example")))
        .when((kind_ == "ip") & form.contains(":"), F.concat_ws(":", F.lit("2001:db8"), *[group(i) for i in range(6)], F.when(longer > 8, group(6))))
        .when(kind_ == "ip", octets)
        .when(kind_ == "phone", F.concat(F.substring(form, 1, 1), F.substring(digits, F.lit(1), n - 1 + longer)))
        .when(kind_ == "iban", with_iban_check(F.substring(form, 1, 2), F.concat(_like(F.substr(form, F.lit(5), n), hexes), F.substring(digits, F.lit(70), longer))))
        .when(kind_ == "card", with_luhn(F.concat(F.substring(form, 1, 1), F.substring(digits, F.lit(1), n - 2 + longer))))
        .when(kind_ == "ssn", F.substring(digits, F.lit(1), n + longer))
        .when((kind_ == "secret") & form.rlike(r"\A[0-9a-f]{32,}\z"), F.substring(whole, F.lit(1), n + longer))
        .when(kind_ == "secret", F.concat(prefix, _like(rest, hexes), F.substring(letters, F.lit(70), longer)))
        .otherwise(name)
    )


def resolve(forms: DataFrame, key: str) -> DataFrame:
    """``type, form, surrogate``: distinct for distinct forms of a type, and never a form that occurs.

    ``forms`` has type, form and, if it matters, gender (f, m, n or null): a form with
    one of f and m alone has that one, otherwise n where any row has one.
    """
    if "gender" not in forms.columns:
        forms = forms.withColumn("gender", F.lit(None).cast("string"))
    only = F.array_remove(F.collect_set("gender"), "n")
    gender = F.when(F.count("gender") > 0, F.when(F.size(only) == 1, only[0]).otherwise("n"))
    real = checkpoint(forms.groupBy("type", "form").agg(gender.alias("gender")))
    again_ = lambda attempt: draw(key, F.col("type"), F.col("form"), attempt, F.col("gender"))
    state = checkpoint(real.select("type", "form", "gender", F.lit(0).alias("attempt"), again_(F.lit(0)).alias("surrogate")))
    taken = real.select("type", F.col("form").alias("surrogate"), F.lit(True).alias("taken"))
    while True:  # draws grow, so that few are left soon and none in the end
        # the first draw keeps a surrogate that several want, unless it is real; a minimum per surrogate needs no window
        keeper = state.groupBy("type", "surrogate").agg(F.min(F.struct("attempt", "form")).alias("keep"), F.count("*").alias("n")).join(taken, ["type", "surrogate"], "left")
        clash = keeper.where((F.col("n") > 1) | F.col("taken")).select("type", "surrogate", "keep", F.coalesce("taken", F.lit(False)).alias("taken"))
        again = state.join(clash, ["type", "surrogate"]).where(F.col("taken") | (F.col("form") != F.col("keep.form"))).select("type", "form", F.lit(True).alias("again"))
        again = checkpoint(again)
        if again.isEmpty():
            return state.select("type", "form", "surrogate")
        moved = state.join(again, ["type", "form"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0))
        state = checkpoint(moved.select("type", "form", "gender", "attempt", F.when(F.col("again"), again_(F.col("attempt"))).otherwise(F.col("surrogate")).alias("surrogate")))


def put_on(entity: Column, surrogate: Column) -> Column:
    """The surrogate of an entity, other than a name, in the entity's own format; what is longer goes to the end."""
    chars = F.split(entity, "")
    spread = lambda pattern, text: F.aggregate(  # noqa: E731  the characters of text in place of those that match, in order
        chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")),
        lambda s, c: F.when(c.rlike(pattern), F.struct(F.concat(s["out"], F.substring(text, s["i"] + 1, F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))),
        lambda s: F.concat(s["out"], F.substr(text, s["i"] + 1, F.length(text))),
    )
    sort = kind(entity)
    label = F.regexp_extract(entity, rf"\A(?:{_LABEL})?", 0)
    upper = (entity == F.upper(entity)) & entity.rlike(r"\p{L}")
    return (
        F.when(sort.isin("phone", "ssn", "card"), spread(r"\d", surrogate))
        .when(sort == "iban", F.when(entity.rlike("[a-z]"), F.lower(spread("[A-Za-z0-9]", surrogate))).otherwise(spread("[A-Z0-9]", surrogate)))
        .when(sort == "secret", F.concat(label, F.when(value(entity).rlike(r"\A[0-9A-F]{32,}\z"), F.upper(surrogate)).otherwise(surrogate)))
        .when(sort.isin("email", "ip") & upper, F.upper(surrogate))
        .otherwise(surrogate)
    )


def rename(piece: Column, words: Column) -> Column:
    """The text with each capitalised word that ``words`` (a map from lower case) has replaced, in the word's own case."""
    def one(token: Column) -> Column:
        new = F.try_element_at(words, F.lower(token))
        styled = F.when((token == F.upper(token)) & (F.length(token) > 1), F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 30)))
        return F.when(token.rlike(r"\A\p{Lu}") & new.isNotNull(), styled).otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(rf"{_LETTER}+|(?:(?!{_LETTER})[\s\S])+"), F.lit(0)), one), "")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """The documents with ``text`` rewritten, and ``n_entities`` and ``entity_kinds`` (sorted, comma-joined) of it.

    The other columns are kept, whatever their names but these two. A null text stays null with
    no entities; a text without entities is unchanged. ``n_entities`` counts what the pattern finds, not
    the words of names that stand alone elsewhere. Repeated rows and equal entities get equal
    surrogates throughout the table; under the same key other tables give the same ones but for those that
    had to be drawn again or whose honorifics there tell another gender. A name needs an honorific once in the document;
    initials, particles and honorifics stay. An empty table gives no rows.
    """
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    rest = F.struct(*[docs[f"`{c}`"] for c in others] or [F.lit(0).alias("none")]).alias("_row")
    packed = docs.select(rest, docs["`text`"].cast("string").alias("_text")).withColumn("_may", F.coalesce(gate(F.col("_text")), F.lit(False)))
    cuts = packed.where(F.col("_may")).select("_row", cut(F.col("_text")).alias("_pieces"))
    # the salt parts copies of one text; it is written with the row, so that no later read of it differs
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    cuts = store(cuts.select("_row", "_pieces", F.xxhash64("_pieces", salt).alias("_key")))
    hit = cuts.where(F.size("_pieces") > 1)
    entities = F.filter("_pieces", lambda _, i: i % 2 == 1)
    occurring = checkpoint(hit.select("_key", F.explode(F.array_distinct(entities)).alias("entity")).distinct())
    known = occurring.select("entity").distinct().withColumn("kind", kind(F.col("entity")))
    split = checkpoint(known.select("entity", "kind", F.posexplode_outer(parts(F.col("entity"))).alias("i", "part")).select("entity", "kind", "i", "part.type", "part.form", "part.gender"))
    drawn = split.join(resolve(split.where("form is not null"), key), ["type", "form"], "left")
    of_names = F.when(F.col("kind") == "name", F.struct("form", "surrogate"))
    host = F.min(F.when(F.col("type") == "host", F.col("surrogate")))
    one = F.min(F.when((F.col("kind") != "name") & (F.col("type") != "host"), F.col("surrogate")))
    made = drawn.groupBy("entity", "kind").agg(F.when(host.isNotNull(), F.concat(one, F.lit("@"), host)).otherwise(one).alias("one"), F.collect_set(F.when(F.col("form").isNotNull(), of_names)).alias("words"))
    made = checkpoint(made.select("entity", "kind", put_on(F.col("entity"), F.col("one")).alias("new"), "words"))
    maps = occurring.join(made, "entity").groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("entity", "new")))).alias("_map"),
        F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("words")))).alias("_words"),
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("_kinds"),
    )
    elsewhere = F.map_filter("_words", lambda word, _: ~word.isin(*[w.lower() for w in SURNAMES]))
    renamed = lambda p, i: F.when(i % 2 == 1, rename(p, F.col("_words"))).otherwise(rename(p, elsewhere))
    new = F.transform("_pieces", lambda p, i: F.coalesce(F.when(i % 2 == 1, F.try_element_at("_map", p)), F.when(F.size("_words") > 0, renamed(p, i)).otherwise(p)))
    changed = hit.join(maps, "_key").select("_row", F.array_join(new, "").alias("_text"), F.size(entities).cast("long").alias("n_entities"), F.col("_kinds").alias("entity_kinds"))
    none = packed.where(~F.col("_may")).select("_row", "_text").union(cuts.where(F.size("_pieces") == 1).select("_row", F.col("_pieces")[0]))
    same = none.select("_row", "_text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds"))
    return changed.unionByName(same).select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns], "n_entities", "entity_kinds")
