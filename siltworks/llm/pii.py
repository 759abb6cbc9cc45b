"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

One pattern finds the entities. Each has one part (names: first and last name), and a part has a canonical form, so that an address in
capitals or a number with other separators is the same one. Surrogates belong to canonical parts, not to places: what is the same stays the
same in all documents, and `Mr. Smith` follows `John Smith`. Distinctness is checked: a surrogate that another part has already got, or that
is a real value of the corpus, is drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, whole

#: Names by which a person's gender is known, and titles; lower case is not matched.
FEMALE = ("Mary", "Anna", "Emma", "Laura", "Julia", "Sarah", "Linda", "Susan", "Elizabeth", "Jennifer", "Maria", "Sofia", "Camille", "Claire", "Lucía", "Carmen", "Katharina", "Ingrid", "Анна", "Мария", "Ольга", "Елена", "Наталья")
MALE = ("John", "James", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "Daniel", "Carlos", "José", "Pierre", "François", "Hans", "Jürgen", "Klaus", "Stefan", "Иван", "Сергей", "Дмитрий", "Алексей", "Владимир")
MS, MR, ANY = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"), ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"), ("Dr", "Prof")
HAN_FAMILY, HAN_MS, HAN_MR = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗", ("女士", "小姐"), ("先生",)

#: What surrogate names are made of: syllables and endings by script.
SYLLABLES = {"latin": "ba be bo da del dor fa fen ga gal ha hel ka kel la len lo ma mel mor na nel ra ren sa sel ta tor va vel".split(), "cyrillic": "ба бо да де до ка ко ла ле лю ма ми мо на не ни ра ро са се та ти ва ве".split(), "han": list("安伯长承德恩方光国和华嘉建景康立明宁平启清荣思泰文新兴永远云")}
ENDINGS = {
    "first_f": {"latin": "ina ella ara ette ia".split(), "cyrillic": "ина елла ара ия".split(), "han": list("芳丽娟婷雪")},
    "first_m": {"latin": "ander ric ton bert win".split(), "cyrillic": "ислав имир ан ей".split(), "han": list("伟强军勇刚")},
    "first_n": {"latin": "en is ley an".split(), "cyrillic": "ша ля ня".split(), "han": list("文华宁平")},
    "last": {"latin": "son berg man field er".split(), "cyrillic": "енко ских ук ян".split(), "han": list("欧阳司马")},
}

_CAP = r"\p{Lu}[\p{L}'’-]{1,40}"
_TITLE = rf"(?:{'|'.join((*MS, *MR, *ANY))})\.?"
_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Words after which two capitalised words are a person's name.
CUES = ("my name is", "name is", "Name:", "named", "je m'appelle", "ich heiße", "me llamo", "mi nombre es", "меня зовут", "signed by", "Dear", "Liebe", "Lieber", "Cher", "Chère", "Querido", "Querida")
#: Kinds in order of precedence: what stands around the entity, and the entity. Repetitions are bounded or possessive, so time is linear.
KINDS: dict[str, tuple[str, str, str]] = {
    "email": (r"(?<![\p{L}\p{N}._%+-])", r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}", ""),
    "secret": (_B, r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})", _E),
    "iban": (_B, r"[A-Z]{2}\d{2} ?(?:[A-Z]{4} ?)?(?:\d{4} ?){2,6}\d{1,4}", _E),
    "ipv6": (r"(?<![\p{L}\p{N}:])", r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", r"(?![\p{L}\p{N}:])"),
    "ssn": (r"(?<![\d-])", r"\d{3}-\d{2}-\d{4}", r"(?![\d-])"),
    "ip": (r"(?<![\d.])", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"(?!\.?\d)"),
    "card": (r"(?<!\d)", r"(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{13,19})", r"(?!\d)"),
    "phone": (r"(?<![\p{L}\p{N}+])", r"(?:(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[.-]\d{3,4}|(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3} )\d{3,4} \d{4}|\+\d{1,3}(?:[ .-]?\(?\d{2,8}\)?){1,5})", r"(?!\d)"),
    "name": (_B, rf"(?:{_TITLE} {_CAP}(?: {_CAP})?|(?:{'|'.join((*FEMALE, *MALE))}) {_CAP}|(?=\p{{Lu}})(?<=(?:{'|'.join(CUES)}) ){_CAP} {_CAP})", r"(?!\p{L})"),
    "han": ("", rf"[{HAN_FAMILY}]\p{{IsHan}}{{0,2}}?(?:{'|'.join((*HAN_MS, *HAN_MR))})", ""),
}
PATTERN = "|".join(f"(?:{a}{p}{z})" for a, p, z in KINDS.values())

#: Cheap conditions of which every entity meets one, so that most clean texts are passed over without the long pattern.
HINTS = (r"[0-9@]|:[a-fA-F]{1,4}:|[a-fA-F]{32}|sk-|gh[pousr]_|AKIA|" + "|".join((*HAN_MS, *HAN_MR)), rf"(?=\p{{Lu}})(?:{_B}(?:{'|'.join((*MS, *MR, *ANY, *FEMALE, *MALE))})[. ]|(?<=(?:{'|'.join(CUES)}) ))")

#: Draws after which a surrogate gets longer; draws after which the job ends, which only kinds of fixed length could reach; copies of the table of surrogates for joins with hot values.
WIDEN, MOST_DRAWS, SALTS = 6, 60, 8


def has_entity(text: Column) -> Column:
    return (text.rlike(HINTS[0]) | text.rlike(HINTS[1])) & text.rlike(PATTERN)


def entities(text: Column) -> Column:
    """array of (pos, comp, kind, before, raw): the parts of all entities of a text, and what is before a part within its entity."""
    title, last = rf"^({_TITLE} )?(.*)$", r"^(.*) ([^ ]+)$"

    def part(pos, comp, kind, before, raw):
        return F.struct(pos.alias("pos"), F.lit(comp).alias("comp"), kind.alias("kind"), before.alias("before"), raw.alias("raw"))

    def parts(raw, pos):
        one = F.coalesce(*[F.when(raw.rlike(f"^(?:{p})$"), F.lit(k)) for k, (_, p, _) in KINDS.items()], F.when(raw.rlike(f"^{_CAP} {_CAP}$"), F.lit("name")))
        head, rest = F.regexp_extract(raw, title, 1), F.regexp_extract(raw, title, 2)
        given, family = F.regexp_extract(rest, last, 1), F.regexp_extract(rest, last, 2)
        known = F.when(given.isin(*FEMALE), "f").when(given.isin(*MALE), "m")
        by_title = F.regexp_replace(head, r"[. ]", "")
        gender = F.coalesce(known, F.when(by_title.isin(*MS), "f").when(by_title.isin(*MR), "m"), F.lit("n"))
        named = F.when(given == "", F.array(part(pos, 0, F.lit("last"), head, rest))).otherwise(F.array(part(pos, 0, F.concat(F.lit("first_"), gender), head, given), part(pos, 1, F.lit("last"), F.lit(" "), family)))
        # In Chinese the family name is the first character, and the title the last two.
        after = F.substring(raw, -2, 2)
        chosen = F.when(after.isin(*HAN_MS), F.lit("first_f")).otherwise(F.lit("first_m"))
        inner = F.regexp_extract(raw, r"^.(.*)..$", 1)
        end = part(pos, 2, F.lit("keep"), F.lit(""), after)
        han = F.when(inner == "", F.array(part(pos, 0, F.lit("last"), F.lit(""), F.substring(raw, 1, 1)), end)).otherwise(F.array(part(pos, 0, F.lit("last"), F.lit(""), F.substring(raw, 1, 1)), part(pos, 1, chosen, F.lit(""), inner), end))
        return F.when(one == "name", named).when(one == "han", han).otherwise(F.array(part(pos, 0, F.coalesce(one, F.lit("phone")), F.lit(""), raw)))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), parts))


def canonical(kind: Column, raw: Column) -> Column:
    """What two ways to write the same value have in common."""
    bare = F.upper(F.regexp_replace(raw, r"[^\p{L}\p{N}]", ""))
    return F.when(kind.isin("card", "phone", "ssn", "iban"), bare).when(kind == "secret", raw).otherwise(F.lower(raw))


def family(kind: Column) -> Column:
    """Values of one family must differ; first and last names are one."""
    return F.when(kind.startswith("first_") | (kind == "last"), F.lit("name")).otherwise(kind)


def _draw(seed: Column, at: Column | int, most: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed, at.cast("string")), 256), 1, 12), 16, 10).cast("long") % most


def _pick(seed: Column, at: Column | int, of: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in of]), _draw(seed, at, len(of)).cast("int"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _scrambled(text: Column, seed: Column) -> Column:
    """Digits for digits and letters for letters, in their case; hexadecimal strings stay so."""
    low = F.when(text.rlike("^[0-9a-f:]+$"), F.lit("abcdef")).otherwise(F.lit("abcdefghijklmnopqrstuvwxyz"))
    high = F.when(text.rlike("^[0-9A-F:]+$"), F.lit("ABCDEF")).otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    def one(v, c, i):
        pool = F.when(c.rlike(r"\p{Nd}"), F.lit("0123456789")).when(c.rlike(r"\p{Lu}"), v["high"]).when(c.rlike(r"\p{L}"), v["low"])
        n = F.conv(F.substring(F.sha2(F.concat_ws(":", v["seed"], i.cast("string")), 256), 1, 12), 16, 10).cast("long")
        return F.coalesce(F.substring(pool, (n % F.length(pool) + 1).cast("int"), F.lit(1)), c)

    # Bound as the item of an array, text and seed are computed once and not for every character.
    once = F.array(F.struct(text.alias("text"), seed.alias("seed"), low.alias("low"), high.alias("high")))
    return F.get(F.transform(once, lambda v: F.array_join(F.transform(_chars(v["text"]), lambda c, i: one(v, c, i)), "")), F.lit(0))


def luhn(digits: Column) -> Column:
    """The check sum of a card number, 0 if it holds."""
    twice = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10


def mod97(iban: Column) -> Column:
    """The check sum of an account number, 1 if it holds."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    return F.aggregate(_chars(moved), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def surrogate(kind: Column, canon: Column, key: str, draw: int) -> Column:
    """The draw-th surrogate, canonical, of a canonical part: a function of the secret key and these alone."""

    def keyed(*parts: Column) -> Column:
        inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)
        return F.sha2(F.concat_ws("\x1f", F.lit(key), inner), 256)

    seed = keyed(kind, canon, F.lit(str(draw)))
    wide = max(0, draw - WIDEN)
    local, domain = F.regexp_extract(canon, "^(.*)@", 1), F.regexp_extract(canon, r"@(.*)(\.[^.]*)$", 1)
    # Addresses with one domain keep one domain; the last label stays.
    email = F.concat(_scrambled(F.concat(local, F.lit("x" * wide)), seed), F.lit("@"), _scrambled(domain, keyed(F.lit("domain"), F.regexp_extract(canon, "@(.*)$", 1))), F.regexp_extract(canon, r"(\.[^.]*)$", 1))
    digits = F.concat(F.substring(canon, 1, 1), F.substr(_scrambled(canon, seed), F.lit(2)))  # the first digit stays
    longer = F.concat(digits, F.substr(_scrambled(F.concat(canon, F.lit("0" * wide)), seed), F.length(canon) + 1))  # a short number may have no free value of its length
    # Groups of four take the place of shorter ones where those have no free value.
    ipv6 = F.regexp_replace(F.substring(F.sha2(seed, 256), 1, 32), "(.{4})(?=.)", "$1:") if wide else _scrambled(canon, seed)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    zero = F.concat(body, F.lit("0"))
    card = F.when(luhn(canon) == 0, F.concat(body, ((10 - luhn(zero)) % 10).cast("string"))).otherwise(digits)
    rest = _scrambled(F.substr(canon, F.lit(5)), seed)
    check = F.lpad((98 - mod97(F.concat(F.substring(canon, 1, 2), F.lit("00"), rest))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canon, 1, 2), F.when(mod97(canon) == 1, check).otherwise(F.substring(_scrambled(canon, seed), 3, 2)), rest)
    octet = [(_draw(seed, i, 254) + 1).cast("string") for i in range(4)]
    first = _pick(seed, 9, [str(n) for n in range(11, 224) if n not in (127, 169, 172, 192)])
    ip = F.concat_ws(".", first, *octet[1:])
    if not wide:  # private addresses stay private
        ip = F.when(canon.startswith("10."), F.concat_ws(".", F.lit("10"), *octet[1:])).when(canon.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), *octet[2:])).when(canon.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), (_draw(seed, 7, 16) + 16).cast("string"), *octet[2:])).otherwise(ip)
    script = F.when(canon.rlike(r"\p{IsHan}"), "han").when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    name = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        stem = F.concat(*[_pick(seed, i, syllables) for i in range((1 if s == "han" else 2) + wide // 2 + (draw > 2))])
        for k, by in ENDINGS.items():
            # A Chinese family name is a character or two.
            made = stem if (s, k) == ("han", "last") else F.concat(stem, _pick(seed, 99, by[s]))
            name = F.when((script == s) & (kind == k), made).otherwise(name)
    secret = F.concat(F.regexp_extract(canon, "^(AKIA|gh[pousr]_|sk-)?", 1), _scrambled(F.concat(F.regexp_extract(canon, "^(AKIA|gh[pousr]_|sk-)?(.*)$", 2), F.lit("0" * wide)), seed))
    return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", ip).when(kind.isin("phone", "ssn"), longer if wide else digits).when(kind == "ipv6", ipv6).otherwise(name)


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon), distinct, to (kind, canon, sur): within a family no two have one surrogate, and none is a real value.

    Each round draws for what is left, and one aggregation settles who keeps a value: real values first, then earlier rounds, then the
    smallest canonical form. Rounds are few, as most draws are free, and where they aren't, surrogates get longer by a digit a round. IPv4
    addresses, cards and account numbers keep their length; the job ends with an error if the corpus holds nearly all values of one of these.
    """
    real = parts.select(family(F.col("kind")).alias("family"), F.col("canon").alias("value")).distinct().select("*", F.struct(F.lit(0).alias("rank"), F.lit("").alias("kind"), F.lit("").alias("canon")).alias("who"))
    left, done = parts, None
    for draw in range(MOST_DRAWS):
        drawn = cut(left.select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), key, draw).alias("sur")))
        claims = drawn.select(family(F.col("kind")).alias("family"), F.col("sur").alias("value"), F.struct(F.lit(1).alias("rank"), "kind", "canon").alias("who"))
        if done is not None:
            claims = claims.unionByName(done.select(family(F.col("kind")).alias("family"), F.col("sur").alias("value"), F.struct(F.lit(0).alias("rank"), F.lit("").alias("kind"), F.lit("").alias("canon")).alias("who")))
        won = claims.unionByName(real).groupBy("family", "value").agg(F.min("who").alias("who")).filter("who.rank = 1").select("who.kind", "who.canon", F.col("value").alias("sur"))
        done = cut(won if done is None else done.unionByName(won))
        left = drawn.select("kind", "canon").join(done.select("kind", "canon"), ["kind", "canon"], "left_anti")
        if left.isEmpty():
            return done
        left = cut(left)
    raise ValueError(f"{MOST_DRAWS} draws left values without a surrogate of their own")


def _written(kind: Column, raw: Column, sur: Column) -> Column:
    """A canonical surrogate in the format of the place: its separators, or its case. What is longer than the place stands at its last digit."""
    size = F.length(F.regexp_replace(raw, r"[^\p{L}\p{N}]", ""))

    def one(c, i):
        n = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(sur, n, F.when(n == size, F.length(sur)).otherwise(1))).otherwise(c)

    filled = F.array_join(F.transform(_chars(raw), one), "")
    cased = F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(sur)).when(family(kind) == "name", F.initcap(sur)).otherwise(sur)
    return F.when(kind == "keep", raw).when(kind.isin("card", "phone", "ssn", "iban"), filled).when(kind == "secret", sur).otherwise(cased)


def pii_surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in text_col, and two more columns: pii_count (entities replaced, long) and pii_kinds (their kinds, sorted).

    Finds e-mail addresses, keys and tokens, account numbers, IPv4 and whole IPv6 addresses, social security, card and phone numbers, and
    names after a title or a known first name (Latin, Cyrillic), or before a Chinese title. A found family name of letters is also replaced
    where it stands alone in the same text. `key` is the secret on which all surrogates depend; who has it can tell values from surrogates by
    trying them, so it must not be empty. Null texts stay
    null, empty and clean texts as they are; copies and repeated rows get the same text; an empty table stays empty. Other columns pass
    through, but pii_count and pii_kinds are replaced where docs has them.

    What a text gets depends on the text, so parts are kept by a digest of it and copies are one. The table of surrogates is copied SALTS
    times, so that the places of a value found everywhere spread over as many tasks. Only texts with entities move.
    """
    if not key:
        raise ValueError("a secret key is needed")
    the_k, the_parts, the_alone, the_gaps = (fresh(docs, n) for n in ("k", "parts", "alone", "gaps"))
    names = [c for c in docs.columns if c.lower() not in ("pii_count", "pii_kinds")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    text = whole(text_col)
    none = [F.lit(0).cast("long").alias("pii_count"), F.array().cast("array<string>").alias("pii_kinds")]
    found = docs.filter(has_entity(text))
    digest = F.unhex(F.sha2(text, 256))
    parts = found.select(digest.alias("k"), text.alias("t")).select("k", F.explode(entities(F.col("t"))).alias("e")).select("k", "e.*").distinct()
    parts = cut(parts.withColumn("canon", canonical(F.col("kind"), F.col("raw"))))
    table = surrogates(parts.filter("kind <> 'keep'").select("kind", "canon").distinct(), key)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = parts.withColumn("salt", F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["kind", "canon", "salt"], "left")
    placed = placed.select("k", F.struct("pos", "comp", "kind", "before", "raw", _written(F.col("kind"), F.col("raw"), F.col("sur")).alias("out")).alias("p"))
    per_text = cut(placed.groupBy("k").agg(F.sort_array(F.collect_list("p")).alias(the_parts)).withColumnRenamed("k", the_k))

    alone = F.map_from_entries(F.array_distinct(F.transform(F.filter(the_parts, lambda p: p["kind"] == "last"), lambda p: F.struct(p["raw"], p["out"]))))
    words = lambda g: F.split(g, r"(?<!\p{L})(?=\p{L})|(?<=\p{L})(?!\p{L})", -1)
    gap = lambda g: F.when(F.size(the_alone) > 0, F.array_join(F.transform(words(g), lambda w: F.coalesce(F.try_element_at(the_alone, w), w)), "")).otherwise(g)
    whole_text = F.concat(F.array_join(F.transform(the_parts, lambda p: F.concat(F.when(p["comp"] == 0, F.get(the_gaps, p["pos"])).otherwise(F.lit("")), p["before"], p["out"])), ""), F.element_at(the_gaps, -1))
    count = F.size(F.filter(the_parts, lambda p: p["comp"] == 0)).cast("long")
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter(the_parts, lambda p: p["kind"] != "keep"), lambda p: F.when(p["kind"].startswith("first_") | (p["kind"] == "last"), F.lit("name")).otherwise(p["kind"]))))
    joined = found.withColumn(the_k, digest).join(per_text, the_k).withColumns({the_alone: alone, the_gaps: F.split(text, PATTERN, -1)})
    joined = joined.withColumn(the_gaps, F.transform(the_gaps, gap))
    changed = joined.select(*[whole_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], count.alias("pii_count"), kinds.alias("pii_kinds"))
    return docs.filter(~has_entity(text)).select("*", *none).unionByName(changed)
