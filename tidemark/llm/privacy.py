"""Surrogates for personal data (operator 10, native).

Entities are found by patterns: e-mail, IPv4 and IPv6 addresses, phone numbers (international, North American, and national
ones with a leading 0), card and social security numbers, IBANs, access keys, values after a password-like name in
any case, and names after a title or a cue such as ``name:``, or with a known first name. Version and section numbers of
four parts, ``Ms Office`` and the like are passed over. Names without title, cue or known first name, street addresses and
dates of birth are not found.

Each entity gets a surrogate of its type, derived from a keyed digest of its canonical form: letters become letters
of the same case and script, digits become digits, signs stay; cards keep their issuer digit and their check-sum
state, IBANs their country and their check digits' validity, phones their country code, addresses stay addresses, hexadecimal
stays hexadecimal. A known first name becomes another of the same gender and script (the next in a keyed
order of the list, so no two meet); a surname becomes another word of its script, and one after a woman's title keeps a
woman's ending. The same entity has the same surrogate everywhere, in whatever format it is written.

Collision checks: all distinct entities of the corpus are gathered by type; a surrogate that another entity has
too, or that is itself an entity of the corpus, is drawn anew with the next round number, until none is left. A format can
be full: there are 676 addresses like ``a@b.co``. So every ``GROW`` rounds the surrogates become a character longer
(an IPv4 address becomes an IPv6 one), and all entities are served.
Documents are rewritten in place, without a shuffle, where round 0 settled all entities. Else only documents with an
entity take part in a join, by broadcast where the texts with entities of later rounds are few.

Defined cases: a null text stays null; texts without entities are unchanged; repeated rows are rewritten alike; of two
patterns that match at one place the first of the list counts; a text is rewritten whole, whatever its length; extra
columns stay, whatever their names, but the name of the count column must be new; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, free_names, small_enough, stored

# Titles and first names by gender and script.
TITLES_M = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа"]
FIRST = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Hans", "Klaus", "Pierre", "Carlos", "Miguel"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Anna", "Ursula", "Ingrid", "Camille", "Maria", "Lucia"],
    "cm": ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"],
    "cf": ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина"],
}
CUES = ["name", "Name", "NAME", "patient", "Patient", "contact", "Contact", "employee", "Employee", "customer", "Customer"]
PRODUCTS = ["Access", "Edge", "Excel", "Exchange", "Office", "Outlook", "Paint", "Project", "Teams", "Windows", "Word"]
PAGEANTS = ["America", "Earth", "Europe", "France", "Germany", "International", "Universe", "World"]
NUMBERED = ["build", "chapter", "clause", "paragraph", "release", "revision", "section", "sections", "ver", "version", "versions", "v"]
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+)?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Types in the order in which a place of the text is tried.
PATTERNS = {
    "none": rf"\b(?i:{'|'.join(NUMBERED)})[ .:]{{0,2}}[0-9]+(?:\.[0-9]+){{3}}|\b(?:Ms\.? (?:{'|'.join(PRODUCTS)})|Miss (?:{'|'.join(PAGEANTS)}))\b",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:password|passwd|pwd|token|secret|api_?key) {0,2}[=:] {0,2}[\"']?[A-Za-z0-9+/_-]{8,}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])|(?<![0-9.,/-])0(?=(?:[ /-]?[0-9]){8,11}(?![0-9]))[0-9]{1,4}[ /-][0-9]{2,8}(?:[ -][0-9]{2,4}){0,4}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,8}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "name": rf"\b(?:{'|'.join(TITLES_M + TITLES_F)})\.? {_CAP}(?: {_CAP})?|\b(?:{'|'.join(CUES)})(?: is|[:=]) {_CAP} {_CAP}|\b(?:{'|'.join(sum(FIRST.values(), []))}) {_CAP}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: One of these is in every text with an entity; they are quick to rule out.
SIGNS = (r"[0-9@]|A[KS]IA", rf"\b(?:{'|'.join(CUES)})(?: is|[:=]) ", r"(?i:(?:passw|pwd|token|secret|api_?key)[a-z]{0,4}) {0,2}[=:]", rf"(?=[A-ZА-ЯЁ])\b(?:{'|'.join(TITLES_M + TITLES_F + sum(FIRST.values(), []))})\.? ")
#: What stands before a secret's value in its match.
SECRET_HEAD = r"^([A-Za-z_]+ {0,2}[=:] {0,2}[\"']?)"
#: Characters of the stream that a digit or letter takes.
_WIDE = 4
#: Rounds after which surrogates grow by a character.
GROW = 8


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(hit: Column) -> Column:
    out = F.lit("none")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(hit.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    # Sixteen digits whose check sum is not zero are no card.
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return F.when((out == "card") & (_luhn(digits) != 0), F.lit("none")).otherwise(out)


def canonical(kind: Column, hit: Column) -> Column:
    """The form that all spellings of an entity share."""
    plain = F.regexp_replace(hit, "[^A-Za-z0-9]", "")
    return F.when(kind == "email", F.lower(hit)).when(kind == "secret", F.regexp_replace(hit, SECRET_HEAD, "")).when(kind.isin("phone", "card", "ssn", "iban"), plain).otherwise(hit)


def _stream(key: str, kind: Column, value: Column, turn: Column) -> Column:
    """Hexadecimal keyed digits, four for each character of the value."""
    blocks = F.sequence(F.lit(0), F.ceil(F.length(value) * _WIDE / 128).cast("int"))
    seed = F.concat_ws("\x1f", F.lit(key), kind, turn.cast("string"), value)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(seed, F.lit("\x1f"), b.cast("string")), 512)), "")


def _draw(stream: Column, i: Column, n: int | Column) -> Column:
    return F.pmod(F.conv(F.substring(stream, i * _WIDE + 1, F.lit(_WIDE)), 16, 10).cast("int"), F.lit(n) if isinstance(n, int) else n)


def _letter(base: str, n: int, draw) -> Column:
    letters = "".join(chr(ord(base) + i) for i in range(n))
    return F.substring(F.lit(letters), draw(n) + 1, F.lit(1))


def _character(kind: Column, hexadecimal: Column, keep: Column, c: Column, i: Column, stream: Column) -> Column:
    draw = lambda n: _draw(stream, i, n)
    out = F.when(keep, c).when(c.rlike("[0-9]"), draw(10).cast("string"))
    out = out.when(hexadecimal & c.rlike("[a-f]"), _letter("a", 6, draw))
    out = out.when(hexadecimal & c.rlike("[A-F]"), _letter("A", 6, draw))
    for pattern, base, n in (("[a-z]", "a", 26), ("[A-Z]", "A", 26), ("[а-яё]", "а", 32), ("[А-ЯЁ]", "А", 32)):
        out = out.when(c.rlike(pattern), _letter(base, n, draw))
    out = out.when(c.rlike("[à-öø-ÿ]"), _letter("a", 26, draw)).when(c.rlike("[À-ÖØ-Þ]"), _letter("A", 26, draw))
    return out.otherwise(c)


def _luhn(digits: Column) -> Column:
    """Check sum of 16 digits, mod 10."""

    def add(s: Column, x: Column) -> Column:
        d = x["c"].cast("int")
        twice = F.when(x["i"] % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return s + twice

    chars = F.transform(F.split(digits, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.pmod(F.aggregate(F.filter(chars, lambda x: x["c"] != ""), F.lit(0), add), F.lit(10))


def _mod97(iban: Column) -> Column:
    """An IBAN's remainder: its first four characters last, letters as two digits."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def surrogate(key: str, kind: Column, value: Column, turn: Column) -> Column:
    """The surrogate of a canonical form (a name's word, for names), in canonical form."""
    # What a later round adds takes its class from the last character; an address grows at its head.
    more = F.when(kind.isin("card", "iban", "ip"), 0).otherwise(F.floor(turn / GROW)).cast("int")
    last = F.when(value.rlike("[0-9]$"), "0").when(value.rlike("[A-Z]$"), "A").when(value.rlike("[а-яё]$"), "а").otherwise("a")
    grown = F.when(kind == "email", F.concat(F.repeat(F.lit("a"), more), value)).otherwise(F.concat(value, F.repeat(last, more)))

    def keep(i: Column) -> Column:
        country = F.when(F.length(value) > 10, F.length(value) - 10).otherwise(0)  # a phone's country code and first area digit stay
        return F.when(kind == "phone", i <= country).when(kind == "card", i == 0).when(kind == "key", i < 4).when(kind == "iban", i < 2).otherwise(F.lit(False))

    hexadecimal = (kind == "ipv6") | ((kind == "secret") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    woman = kind == "surname_f"

    def drawn(stream: Column) -> Column:
        text = F.array_join(F.transform(F.split(grown, ""), lambda c, i: _character(kind, hexadecimal, keep(i), c, i, stream)), "")
        # The host's last label stays, so that the address is one.
        email = let(text, lambda t: F.concat(F.regexp_extract(t, r"^(.*\.)[^.]+$", 1), F.regexp_extract(value, r"([^.]+)$", 1)))
        address = F.concat_ws(".", *[(_draw(stream, F.lit(i), 223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
        longer = F.concat(F.lit("fd"), F.substring(stream, 1, 2), *[F.concat(F.lit(":"), F.substring(stream, 4 * i + 1, 4)) for i in range(1, 8)])
        # The last digit is what leaves the check sum as it was.
        card = let(F.concat(F.substring(text, 1, 15), F.lit("0")), lambda t: F.concat(F.substring(t, 1, 15), F.pmod(_luhn(value) - _luhn(t), F.lit(10)).cast("string")))
        rest = F.substring(text, F.lit(5), F.length(text))
        valid = F.concat(F.substring(text, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(text, 1, 2), F.lit("00"), rest))).cast("string"), 2, "0"), rest)
        endings = F.when(woman & value.rlike("[аеи]я$|[ео]ва$|ина$"), F.concat(F.substring(text, F.lit(1), F.length(text) - 2), F.lit("ва")))
        ip = F.when(turn < GROW, address).otherwise(longer)
        return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when((kind == "iban") & (_mod97(value) == 1), valid).when(endings.isNotNull(), endings).otherwise(text)

    return let(_stream(key, kind, grown, turn), drawn)


def _as_written(hit: Column, made: Column) -> Column:
    """A canonical surrogate in the format of the mention: signs and case of the mention, characters of the surrogate."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        x = F.substring(made, s["at"], F.lit(1))
        return F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(s["out"], x).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    # What a later round has added comes last.
    return let(F.aggregate(F.split(hit, ""), zero, put), lambda s: F.concat(s["out"], F.substring(made, s["at"], F.length(made))))


def _email_case(hit: Column, made: Column) -> Column:
    more = F.length(made) - F.length(hit)
    return F.array_join(F.transform(F.split(made, ""), lambda c, i: F.when(F.substring(hit, i - more + 1, F.lit(1)).rlike("[A-Z]") & (i >= more), F.upper(c)).otherwise(c)), "")


def name_words(hit: Column) -> Column:
    """A name's words with their parts: title (or cue), known first names by list, or surname by gender."""
    words = F.split(hit, " ")
    first = F.regexp_replace(F.get(words, F.lit(0)), r"[.:=]$", "")
    known = F.when(first.isin(*CUES), F.get(words, F.size(words) - 2)).otherwise(first)
    woman = known.isin(*TITLES_F, *FIRST["f"], *FIRST["cf"])

    def part(w: Column, i: Column) -> Column:
        out = F.when(((i == 0) & first.isin(*TITLES_M, *TITLES_F, *CUES)) | (w == "is"), F.lit("title"))
        for name, known in FIRST.items():
            out = out.when((i < F.size(words) - 1) & w.isin(*known), F.lit(f"first_{name}"))
        return F.struct(w.alias("w"), out.when(woman, F.lit("surname_f")).otherwise(F.lit("surname")).alias("part"))

    return F.transform(words, part)


def _rotated(key: str, part: Column, word: Column) -> Column:
    """A known first name's successor in the keyed order of its list."""
    out = word
    for name, known in FIRST.items():
        order = sorted(known, key=lambda w, name=name: hashlib.sha256(f"{key}|{name}|{w}".encode()).hexdigest())
        table = F.create_map(*[F.lit(x) for w, v in zip(order, [*order[1:], order[0]], strict=True) for x in (w, v)])
        out = F.when(part == f"first_{name}", F.element_at(table, word)).otherwise(out)
    return out


def hits_of(text: Column) -> Column:
    """The matches of a text, null where no sign of an entity is found."""
    signs = text.rlike(SIGNS[0])
    for sign in SIGNS[1:]:
        signs = signs | text.rlike(sign)
    return F.when(signs, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def mentions(hits: Column) -> Column:
    """array<struct<kind, value>> of the entities that a surrogate is drawn for."""

    def units(h: Column) -> Column:
        return let(kind_of(h), lambda k: F.when(k == "name", F.transform(F.filter(name_words(h), lambda w: w["part"].startswith("surname")), lambda w: F.struct(w["part"].alias("kind"), w["w"].alias("value")))).when(k == "none", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(F.array(F.struct(k.alias("kind"), canonical(k, h).alias("value")))))

    return F.flatten(F.transform(hits, units))


def rewritten(text: Column, hits: Column, key: str, rounds: Column | None) -> Column:
    """The text with surrogates; ``rounds`` maps kind and value to a later round, where there is one."""

    def turn(kind: Column, value: Column) -> Column:
        return F.lit(0) if rounds is None else F.coalesce(F.try_element_at(rounds, F.concat_ws("\x1f", kind, value)), F.lit(0))

    def word(w: Column) -> Column:
        return F.when(w["part"] == "title", w["w"]).when(w["part"].startswith("first"), _rotated(key, w["part"], w["w"])).otherwise(surrogate(key, w["part"], w["w"], turn(w["part"], w["w"])))

    def replaced(h: Column) -> Column:
        def by_kind(k: Column) -> Column:
            plain = let(canonical(k, h), lambda v: surrogate(key, k, v, turn(k, v)))
            made = let(plain, lambda m: F.when(k.isin("phone", "card", "ssn", "iban"), _as_written(h, m)).when(k == "email", _email_case(h, m)).when(k == "secret", F.concat(F.regexp_extract(h, SECRET_HEAD, 1), m)).otherwise(m))
            return F.when(k == "none", h).when(k == "name", F.array_join(F.transform(name_words(h), word), " ")).otherwise(made)

        return let(kind_of(h), by_kind)

    made = F.transform(hits, replaced)
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), made, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, joined).otherwise(text)


def settled(entities: DataFrame, key: str, most_rounds: int = 64) -> DataFrame:
    """(kind, value, turn) of the entities whose surrogate is not that of round 0; entities(kind, value) is stored and distinct."""
    pending, taken, late = entities, None, None
    for turn in range(most_rounds):
        drawn = stored(pending.select("kind", "value", surrogate(key, F.col("kind"), F.col("value"), F.lit(turn)).alias("made")), "drawn")
        first = drawn.groupBy("kind", "made").agg(F.min("value").alias("value"))
        free = first.join(entities.select("kind", F.col("value").alias("made")), ["kind", "made"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "made"], "left_anti")
        good = stored(free, "good")
        if turn:
            now = good.select("kind", "value", F.lit(turn).alias("turn"))
            late = now if late is None else late.union(now)
        pending = stored(drawn.join(good.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value"), "pending")
        if small_enough(pending, 0):
            break
        taken = good.select("kind", "made") if taken is None else taken.union(good.select("kind", "made"))
    else:
        raise ValueError(f"some entities find no free surrogate in {most_rounds} rounds")
    return late if late is not None else entities.limit(0).select("kind", "value", F.lit(0).alias("turn"))


def anonymised(docs: DataFrame, key: str, text: str = "text", n_entities: str | None = None) -> DataFrame:
    """The table with surrogates in its text column, and the number of entities in another column if one is named."""
    if n_entities is not None and n_entities.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {n_entities} already")
    found = docs.select(F.explode(mentions(hits_of(F.col(text)))).alias("m")).select("m.*").distinct()
    entities = stored(found, "entities")
    late = stored(settled(entities, key), "late")
    hits, sign, rounds = free_names(docs, "_hits", "_sign", "_rounds")
    # The matches are used more than once, so they stay a column of their own.
    own = docs.withColumn(hits, hits_of(F.col(text)))
    names = list(docs.columns)
    if n_entities is not None:
        own = own.withColumn(n_entities, F.coalesce(F.size(F.filter(hits, lambda h: kind_of(h) != "none")), F.lit(0)))
        names.append(n_entities)
    at_once = own.withColumn(text, rewritten(F.col(text), F.col(hits), key, None)).select(*names)
    if small_enough(late, 0):
        return at_once
    # Texts that mention an entity of a later round, once each, with the rounds of those entities.
    with_hits = F.coalesce(F.size(hits), F.lit(0)) > 0
    signed = own.filter(with_hits).withColumn(sign, F.sha2(F.col(text), 256))
    each = signed.select(sign, F.explode(mentions(F.col(hits))).alias("m")).select(sign, "m.*").distinct().join(broadcast_if_small(late), ["kind", "value"])
    maps = stored(each.groupBy(sign).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "value"), "turn"))).alias(rounds)), "maps")
    joined = signed.join(broadcast_if_small(maps), sign, "left")
    again = joined.withColumn(text, F.when(F.col(rounds).isNull(), rewritten(F.col(text), F.col(hits), key, None)).otherwise(rewritten(F.col(text), F.col(hits), key, F.col(rounds)))).select(*names)
    return again.unionByName(own.filter(~with_hits).select(*names))
