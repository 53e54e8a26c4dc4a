"""Surrogate generation for personal data: keyed, type-consistent, collision-checked replacements.

Every entity (e-mail, card, account, social-security and phone number, IP address, secret, person's name)
is found by one pattern, reduced to a canonical form (case, separators and a leading +1 aside), and mapped to a
surrogate that depends on the key and the canonical form alone, so all mentions of one entity in the whole corpus get
one surrogate. Names are mapped word by word: a surname keeps its surrogate with or without the first name, first
names keep their gender (from the list of first names, else from the titles that the corpus gives them), Cyrillic
surnames the ending of theirs, and all names their script, capitals, apostrophe and hyphen. Where a name was found, its
words are replaced in the rest of the document too, so no later mention is left; but words of `COMMON` never, and a
word that the document also has in lower case not at the begin of a sentence, where nothing tells it from that word.
All steps over the mentions of one text are linear in them, or look a word up among the text's names by halving.
Numbers keep their length and separators, phone numbers their country, cards their first digit and a valid check digit (digits like a card's without one are no card and stay), accounts their country and valid check digits, private
IP addresses their range, e-mails their shape and top-level domain, secrets their character classes. Not
found: addresses of IP version 6, names in scripts other than Latin and Cyrillic, and names without a title or a
listed first name.

Collision check: all distinct entities of the corpus are grouped by their surrogate; where two share one,
or a surrogate is itself an entity of the corpus, all but the first try the next attempt number, until no
collision is left. Names, secrets, e-mails and phone numbers grow with the attempts, so a free surrogate is
found for any number of entities, and for secrets without a letter or digit; the formats of the other kinds
are fixed (a billion social-security numbers, four billion IP addresses, more of cards and accounts); IP addresses
leave a range that is full. Built from DataFrame functions alone; texts without entities are never shuffled.

Edge cases: null text stays null with no entities; an empty text stays empty. Rows that repeat doc_id and
text get the same result. Entities are found in whole texts of any length. An empty table gives an empty
result. Extra columns pass through unless they carry the name of a result. The label of a secret may be in any
case and may end a longer name (`TOKEN = `, `Password: `, `auth_token=`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_folder, table, written

#: Titles by the gender they tell, and first names by gender and script.
TITLES = {"m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "г-жа"], "n": ["Dr", "Prof"]}
FIRST = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Bob", "Paul", "George", "Charles", "Daniel", "Kevin", "Brian", "Steven", "Edward", "Andrew", "Hans", "Klaus", "Jürgen", "Stefan", "Wolfgang", "Pierre", "Jean", "Luc", "Antoine", "François", "Carlos", "Juan", "Miguel", "Pablo", "José"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Emma", "Alice", "Jane", "Karen", "Nancy", "Laura", "Julia", "Helen", "Barbara", "Margaret", "Anna", "Ursula", "Sabine", "Petra", "Gisela", "Marie", "Claire", "Sophie", "Camille", "Isabelle", "María", "Carmen", "Lucía", "Elena", "Ana"],
}
FIRST_CYRILLIC = {"m": ["Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Борис", "Олег"], "f": ["Мария", "Ольга", "Анна", "Елена", "Татьяна", "Наталья", "Ирина", "Светлана"]}
SYLLABLES = {"latin": ["bar", "den", "fal", "gor", "hel", "kin", "lam", "mor", "nel", "par", "ros", "sten", "tal", "ver", "wil", "zan"], "cyrillic": ["бар", "ден", "фал", "гор", "хел", "кин", "лам", "мор", "нел", "пар", "рос", "стен", "тал", "вер", "вил", "зан"]}
#: Words that begin sentences and are no names where they stand alone.
COMMON = ["The", "And", "But", "For", "Not", "Was", "With", "That", "This", "Der", "Die", "Das", "Und", "Ein", "Eine", "Les", "Des", "Une", "Que", "Pas", "Los", "Las", "Una", "Del", "Por", "Что", "Как", "Это", "Will", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Januar", "Februar", "März", "Mai", "Juni", "Juli", "Oktober", "Dezember"]
#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: The kind of what is found but isn't personal, and so stays.
NUMBER = "number"
LETTERS, DIGITS = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")

_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)?"
_CAPITALS = r"\p{Lu}{2,}(?:['’-]\p{Lu}{2,})?"
_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_FIRST = "|".join(n for names in (*FIRST.values(), *FIRST_CYRILLIC.values()) for n in names)
#: A name in one way of writing: capitalised words, or capitals throughout.
_AFTER = rf"(?:{_NAME}(?: {_NAME})?|{_CAPITALS}(?: {_CAPITALS})?)"
#: One alternative for each kind, tried in this order at each place. Each begins with a cheap necessary condition
#: on one or two characters, so that most places of a text are passed without the costly part.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?=A)\bAKIA[0-9A-Z]{16}\b|(?<=[=: \"'])(?<=[=:] ?[\"']?)(?<=(?i:password|passwd|pwd|token|secret|api_key|apikey) ?[=:] ?[\"']?)[^\s\"',;=:]{6,}|(?=[spgx])\b(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}",
    "card": r"(?=[3-6])(?:(?<![0-9])[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9]))",
    "account": r"(?=[A-Z][A-Z][0-9])\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "phone": r"(?=[0-9+( .-])(?:(?<![0-9])\+?[0-9]{0,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9.,/-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![0-9])|(?<![0-9.,/-])0[1-9](?:[ .][0-9]{2}){4}(?!\.?[0-9]))",
    "person": rf"(?=\p{{Lu}})(?:(?<=[ ])(?<=\b(?:{_TITLES})\.? ){_AFTER}|\b(?:(?:{_FIRST}) {_NAME}|(?:{_FIRST.upper()}) {_CAPITALS}))(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every secret holds or follows one of these, in any case.
SECRET_MARKS = ["akia", "password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "sk-", "sk_", "pk-", "pk_", "ghp", "gho", "xoxb", "xoxp"]
WORDS = r"[^\p{L}]+|\p{L}+(?:['’-]\p{L}+)*"
PERSON = rf"^(?:{_NAME}(?: {_NAME})?|{_CAPITALS}(?: {_CAPITALS})?)$"


def kind_of(value: Column) -> Column:
    kind = F.lit("person")
    for name in reversed([k for k in PATTERNS if k not in ("secret", "person")]):
        kind = F.when(value.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    plain = value.rlike(PERSON)
    return F.when(plain, "person").when(kind == "person", "secret").otherwise(kind)


def bare_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[ .()+/-]", "")


def national(value: Column) -> Column:
    """True for a phone number of ten digits with a 1 before them, which says the country and no more."""
    return bare_of(value).rlike("^1[0-9]{10}$")


def canonical(kind: Column, value: Column) -> Column:
    bare = bare_of(value)
    phone = F.when(national(value), F.substr(bare, F.lit(2))).when(value.startswith("+"), F.concat(F.lit("+"), bare)).otherwise(bare)
    small = F.array_join(F.transform(F.split(F.lower(value), "(?<=['’-])"), F.initcap), "")
    name = F.when(value == F.upper(value), small).otherwise(value)
    out = F.when(kind == "email", F.lower(value)).when(kind == "phone", phone).when(kind.isin("card", "account", "ssn"), bare)
    return out.when(kind.rlike("^(first|last)-"), name).otherwise(value)


def hex_of(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """128 hex digits keyed by key, kind, entity and attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|2")), 256))


def number_at(h: Column, at: Column, mod: int) -> Column:
    """A number under mod from the four hex digits at a place of h."""
    return (F.conv(F.substr(h, (at * 3) % 124 + 1, F.lit(4)), 16, 10).cast("int")) % mod


def pick(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), number + 1)


def drawn(words: list[str], h: Column, n: Column, start: int = 0) -> Column:
    """n words, each chosen by its own place of h from `start` on, joined; none for n < 1."""
    one = lambda k: pick(words, number_at(h, k + start, len(words)))
    return F.when(n < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one), ""))


def same_classes(value: Column, h: Column, keep: Column) -> Column:
    """value with each letter and digit after the first `keep` characters replaced by another of its class."""
    def one(c: Column, i: Column) -> Column:
        n = number_at(h, i, 26)
        lower = F.substr(F.lit("".join(LETTERS)), n + 1, F.lit(1))
        return F.when(i < keep, c).when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), F.upper(lower)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def check_digit(head: Column) -> Column:
    """The Luhn check digit that completes a string of digits."""
    n = F.length(head)

    def one(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    total = F.aggregate(F.transform(F.split(head, ""), one), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return ((10 - total % 10) % 10).cast("string")


def valid_card(value: Column) -> Column:
    """True for digits whose last one is the check digit of those before it; other runs of digits are no card."""
    bare = bare_of(value)
    return check_digit(F.substr(bare, F.lit(1), F.length(bare) - 1)) == F.substr(bare, F.length(bare))


def account_digits(country: Column, rest: Column) -> Column:
    """The two check digits of an account number: 98 less the remainder by 97 of rest, country and 00, letters as 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    remainder = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)
    return F.lpad((98 - remainder).cast("string"), 2, "0")


def address(entity: Column, h: Column, attempt: Column) -> Column:
    """An IP address of the same private range, or a public one; at late attempts of a wider range."""
    octet = lambda i: (number_at(h, F.lit(i), 254) + 1).cast("string")
    parts = F.split(entity, r"\.")
    second = parts[1].cast("int")
    near = lambda *kept: F.concat_ws(".", *kept, *[octet(k) for k in range(len(kept), 4)])
    out = F.when(attempt >= 20, near()).when(parts[0].isin("10", "127"), near(parts[0]))
    small = (parts[0] == "192") & (parts[1] == "168")
    middle = (parts[0] == "172") & second.between(16, 31)
    out = out.when((small | middle) & (attempt >= 8), near(F.lit("10")))
    out = out.when(small, near(parts[0], parts[1])).when(middle, near(parts[0], (16 + number_at(h, F.lit(9), 16)).cast("string")))
    return out.otherwise(near((128 + number_at(h, F.lit(9), 40)).cast("string")))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical entity. Kinds of name words: first-m, first-f, first-n, last, with their script.

    Surnames and secrets get longer with every second attempt, first names with every fourth, e-mails and phone
    numbers with every eighth, so the surrogates to choose from outgrow any number of entities.
    """
    h = hex_of(key, kind, entity, attempt)
    top = F.regexp_extract(entity, r"\.[^.@]+$", 0)
    longer = lambda words, every: drawn(words, h, F.floor(attempt / every).cast("int"), 20)
    email = F.concat(longer(LETTERS, 8), same_classes(F.substr(entity, F.lit(1), F.length(entity) - F.length(top)), h, F.lit(0)), top)
    head = same_classes(F.substr(entity, F.lit(1), F.length(entity) - 1), h, F.lit(1))
    card = F.concat(head, check_digit(head))
    country, rest = F.substr(entity, F.lit(1), F.lit(2)), same_classes(F.substr(entity, F.lit(5)), h, F.lit(0))
    account = F.concat(country, account_digits(country, rest), rest)
    code = F.length(F.regexp_extract(entity, rf"^\+(?:{CALLING_CODES}|[0-9]{{3}})", 0))
    trunk = F.when(entity.startswith("0"), 1).otherwise(F.greatest(F.length(entity) - 10, F.lit(0)))
    phone = F.concat(same_classes(entity, h, F.when(code > 0, code).otherwise(trunk)), longer(DIGITS, 8))
    secret = F.concat(same_classes(entity, h, F.when(entity.startswith("AKIA"), 4).otherwise(0)), longer(LETTERS, 2))
    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", address(entity, h, attempt)).when(kind == "phone", phone).when(kind == "ssn", same_classes(entity, h, F.lit(0))).when(kind == "account", account)
    for script, lists in (("latin", FIRST), ("cyrillic", FIRST_CYRILLIC)):
        for gender, names in (lists | {"n": lists["m"] + lists["f"]}).items():
            count = F.floor(attempt / 4).cast("int") + entity.contains("-").cast("int")
            first = F.array_join(F.transform(F.sequence(F.lit(0), count), lambda k: pick(names, number_at(h, k, len(names)))), "-")  # noqa: B023
            out = out.when(kind == f"first-{gender}-{script}", first)
        own, size = SYLLABLES[script], F.floor(attempt / 2).cast("int") + 3
        last = F.initcap(drawn(own, h, size))
        # A name of two parts (O'Brien, McDonald, Doe-Smith) has two parts again.
        before = F.initcap(drawn(own, h, F.lit(1), 28))
        last = F.when(entity.contains("-"), F.concat(before, drawn(own, h, F.lit(1), 29), F.lit("-"), last)).when(entity.rlike(r"\p{Ll}\p{Lu}"), F.concat(before, last)).otherwise(last)
        last = F.concat(F.regexp_extract(entity, r"^\p{Lu}['’]", 0), last)
        if script == "cyrillic":
            last = F.concat(last, F.when(entity.rlike("[ая]$"), "ова").otherwise("ов"))
        out = out.when(kind == f"last-{script}", last)
    return out.otherwise(secret)


def fill(value: Column, bare: Column) -> Column:
    """The separators of value with the letters and digits of bare, in order; what bare has more comes last."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(a: Column, c: Column) -> Column:
        sep = c.rlike(r"[ .()+/-]") | (c == "")
        return F.struct(F.concat(a["out"], F.when(sep, c).otherwise(F.substr(bare, a["i"], F.lit(1)))).alias("out"), (a["i"] + F.when(sep, 0).otherwise(1)).alias("i"))

    return F.aggregate(F.split(value, ""), start, step, lambda a: F.concat(a["out"], F.substr(bare, a["i"], F.length(bare))))


def may_hold(text: Column) -> Column:
    """A cheap condition that every text with a mention meets: all kinds but e-mail, secret and person need a digit."""
    found = F.contains(text, F.lit("@")) | text.rlike("[0-9]")
    # The lambda has the lower-case text made once for all marks.
    marked = F.exists(F.array(F.lower(text)), lambda t: reduce(or_, (F.contains(t, F.lit(mark)) for mark in SECRET_MARKS)))
    return found | marked | text.rlike(PATTERNS["person"])


def tagged(docs: DataFrame) -> DataFrame:
    """docs with __values, the mentions of each text in order (none for null): the one search of all texts."""
    none = F.array().cast("array<string>")
    return docs.withColumn("__values", F.when(may_hold(F.col("text")), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none))


def mentions(docs: DataFrame) -> DataFrame:
    """From tagged rows: doc_id, h (hash of the text), pos, sub, value, kind, entity of every mention; a name gives a row for each word.

    What looks like a card but has no valid check digit keeps its place among the mentions under the kind `number`.
    """
    # What stands before a mention ends with the title, where it has one.
    found = docs.filter(F.size("__values") > 0).select("doc_id", F.xxhash64("text").alias("h"), F.arrays_zip(F.col("__values").alias("value"), F.split("text", ANY, -1).alias("before")).alias("values"))
    rows = found.select("doc_id", "h", F.posexplode("values").alias("pos", "found")).select("doc_id", "h", "pos", F.col("found.value").alias("value"), F.right(F.col("found.before"), F.lit(12)).alias("before"))
    rows = rows.filter("value IS NOT NULL").dropDuplicates(["doc_id", "h", "pos"]).withColumn("kind", kind_of(F.col("value")))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "card") & ~valid_card(F.col("value")), NUMBER).otherwise(F.col("kind")))
    gender = F.lit("n")
    for g, titles in TITLES.items():
        if g != "n":
            gender = F.when(F.col("before").rlike(rf"(?<!\p{{L}})(?:{'|'.join(titles)})\.? $"), g).otherwise(gender)
    words = F.when(F.col("kind") == "person", F.split("value", " ")).otherwise(F.array("value"))
    rows = rows.select("doc_id", "h", "pos", "kind", gender.alias("title"), F.size(words).alias("n"), F.posexplode(words).alias("sub", "value"))
    script = F.when(F.col("value").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    shown = canonical(F.lit("first-"), F.col("value"))
    known = lambda g: shown.isin(FIRST[g] + FIRST_CYRILLIC[g])
    told = F.when(known("m"), "m").when(known("f"), "f").when(F.col("n") == 2, F.col("title"))
    name = F.when((F.col("sub") == 0) & told.isNotNull(), F.concat(F.lit("first-"), told, F.lit("-"), script)).otherwise(F.concat(F.lit("last-"), script))
    rows = rows.withColumn("kind", F.when(F.col("kind") == "person", name).otherwise(F.col("kind")))
    return rows.select("doc_id", "h", "pos", "sub", "value", "kind", canonical(F.col("kind"), F.col("value")).alias("entity"))


def one_gender(found: DataFrame, folder: str) -> DataFrame:
    """mentions with one gender for each first name: what most titles of the corpus say; without any, neutral."""
    first = F.split("kind", "-")
    names = found.filter("kind LIKE 'first-%'").groupBy("entity", first[2].alias("script")).agg(F.count_if(first[1] == "f").alias("f"), F.count_if(first[1] == "m").alias("m"))
    gender = F.when(F.col("f") + F.col("m") == 0, "n").when(F.col("f") >= F.col("m"), "f").otherwise("m")
    names = written(names.select("entity", F.lit(True).alias("__first"), "script", F.concat(F.lit("first-"), gender, F.lit("-"), "script").alias("__kind")), folder, "genders")
    told = found.withColumns({"__first": F.col("kind").startswith("first-"), "script": F.when(F.col("kind").startswith("first-"), first[2])})
    joined = told.join(names, ["entity", "__first", "script"], "left")
    return joined.select("doc_id", "h", "pos", "sub", "value", F.coalesce("__kind", "kind").alias("kind"), "entity")


def distinct_surrogates(entities: DataFrame, key: str, folder: str, most: int = 40) -> DataFrame:
    """entities (kind, entity; distinct) with a surrogate that no other entity of the kind has or is."""
    entities = entities.repartition(partitions(entities.sparkSession), "kind", "entity")
    now = written(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.lit(0), key)), folder, "attempt-0")
    for turn in range(1, most):
        real = now.select("kind", F.col("entity").alias("surrogate"))
        twice = now.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first")).filter("n > 1").select("kind", "surrogate", "first")
        taken = now.select("kind", "surrogate").distinct().join(real, ["kind", "surrogate"], "left_semi").withColumn("first", F.lit(None).cast("string"))
        clash = written(twice.unionByName(taken).groupBy("kind", "surrogate").agg(F.min("first").alias("first"), F.max(F.col("first").isNull()).alias("real")), folder, f"clash-{turn}")
        if clash.isEmpty():
            return now
        again = now.join(clash, ["kind", "surrogate"], "left").withColumn("retry", F.col("real") | (F.col("first") != F.col("entity")))
        attempt = F.when(F.coalesce("retry", F.lit(False)), F.col("attempt") + 1).otherwise(F.col("attempt"))
        again = again.select("kind", "entity", attempt.alias("attempt"), "surrogate", "retry")
        now = written(again.select("kind", "entity", "attempt", F.when(F.coalesce("retry", F.lit(False)), surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)).otherwise(F.col("surrogate")).alias("surrogate")), folder, f"attempt-{turn}")
    raise RuntimeError(f"surrogates still collide after {most} attempts")


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is made once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def looked_up(items: Column, field: str, key: Column) -> Column:
    """The first of items (structs, sorted by field) whose field is key, by halving; null without one."""

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        less = F.get(items, middle)[field] < key
        return F.struct(F.when(less, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(less, a["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(items))))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi")), step, lambda a: F.get(items, a["lo"]))
    return held(found, lambda x: F.when(x[field] == key, x))


def with_ordinary(names: Column, text: Column) -> Column:
    """names (value, new; sorted) with `ordinary`: whether text also has the word in lower case."""
    small = F.regexp_extract_all(text, F.lit(r"(?<!\p{L})\p{Ll}+(?!\p{L})"), F.lit(0))
    both = F.array_sort(F.array_intersect(small, F.transform(names, lambda x: F.lower(x["value"]))))
    both = F.transform(both, lambda w: F.struct(w.alias("word")))
    return held(both, lambda b: F.transform(names, lambda x: F.struct(x["value"].alias("value"), x["new"].alias("new"), looked_up(b, "word", F.lower(x["value"])).isNotNull().alias("ordinary"))))


def renamed(text: Column, first: Column, names: Column) -> Column:
    """text with the words of names (value, new, ordinary; sorted) replaced wherever they stand as whole words.

    Ordinary ones stay at the begin of a sentence; `first` says that text begins one. A joined word (Doe-Smith) is
    looked up whole, then by its parts; 's is no part of a name.
    """

    def one(pair: Column) -> Column:
        word, start = pair["word"], pair["before"].rlike(r"[.!?]\s+$|\n\s*$") | (first & ((pair["before"] == "") | pair["before"].isNull()))
        new = lambda w: held(looked_up(names, "value", w), lambda x: F.when(~(x["ordinary"] & start), x["new"]))
        base = F.regexp_replace(word, r"['’]s$", "")
        parts = F.array_join(F.transform(F.split(word, "(?<=['’-])|(?=['’-])"), lambda w: F.coalesce(new(w), w)), "")
        whole = held(base, lambda b: F.concat(new(b), F.substr(word, F.length(b) + 1)))
        return F.when(word.rlike(r"^\p{Lu}"), F.coalesce(whole, F.when(word.rlike("['’-]"), parts), word)).otherwise(word)

    pairs = held(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), lambda w: F.slice(F.arrays_zip(w.alias("word"), F.concat(F.array(F.lit("")), w).alias("before")), F.lit(1), F.size(w)))
    return F.when(F.size(names) == 0, text).otherwise(F.array_join(F.transform(pairs, one), ""))


def replace(docs: DataFrame, key: str = "surrogate-key-1") -> DataFrame:
    """docs with text replaced, n_entities and kinds (sorted, joined by `,`)."""
    folder = shared_folder(docs.sparkSession)
    own = docs.drop("n_entities", "kinds", "__values")
    marked = written(tagged(own), folder, "tagged")
    found = written(one_gender(written(mentions(marked), folder, "words"), folder), folder, "mentions")
    personal = F.col("kind") != NUMBER
    known = distinct_surrogates(found.filter(personal).select("kind", "entity").distinct(), key, folder)
    words = found.join(known.select("kind", "entity", "surrogate"), ["kind", "entity"], "left")
    country = F.when((F.col("kind") == "phone") & national(F.col("value")), "1").otherwise("")
    named = F.col("kind").rlike("^(first|last)-")
    new = F.when(F.col("kind").isin("card", "account", "ssn", "phone"), fill(F.col("value"), F.concat(country, F.ltrim("surrogate", F.lit("+")))))
    new = new.when(named & (F.col("value") == F.upper("value")), F.upper("surrogate")).otherwise(F.coalesce("surrogate", "value"))
    again = named & (F.length("value") >= 3) & ~F.col("value").isin(COMMON)
    words = words.withColumns({"new": new, "name": F.when(again, F.array(F.struct(F.col("value"), new.alias("new")), F.struct(F.upper("value").alias("value"), F.upper(new).alias("new"))))})
    kind = F.when(F.col("kind").rlike("^(first|last)-"), "person").when(personal, F.col("kind"))
    by_doc = words.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sub", "new"))).alias("words"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"),
        F.array_sort(F.flatten(F.collect_set("name"))).alias("names"),
        F.size(F.collect_set(F.when(personal, F.col("pos")))).cast("bigint").alias("__count"),
    )
    by_doc = by_doc.select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h"), "words", "kinds", "names", "__count")
    has = F.size("__values") > 0
    hit = marked.filter(has).join(by_doc, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__h")))
    # A name has its second word right after its first.
    after = lambda i: held(F.get("words", i + 1), lambda w: F.when(w["sub"] > 0, F.concat(F.lit(" "), w["new"])).otherwise(""))
    placed = F.transform("words", lambda w, i: F.when(w["sub"] == 0, F.concat(w["new"], F.coalesce(after(i), F.lit("")))))
    placed = F.filter(placed, lambda x: x.isNotNull())
    zipped = F.arrays_zip(F.split("text", ANY, -1).alias("gap"), placed.alias("new"))
    text = held(with_ordinary(F.col("names"), F.col("text")), lambda names: F.array_join(F.transform(zipped, lambda z, i: F.concat(renamed(z["gap"], i == 0, names), F.coalesce(z["new"], F.lit("")))), ""))
    hit = hit.withColumns({"text": text, "n_entities": F.col("__count")}).select(*own.columns, "n_entities", "kinds")
    rest = marked.filter(~has).withColumns({"n_entities": F.lit(0).cast("bigint"), "kinds": F.lit("")})
    return hit.unionByName(rest.select(*own.columns, "n_entities", "kinds"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities, kinds."""
    return replace(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities", "kinds")
