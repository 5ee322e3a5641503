"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Matches and the text between them come from the same pattern (`regexp_extract_all` and `split`), so their places are running sums
of lengths; everything stays in the row. Running sums are made in blocks of `BLOCK` matches and texts are cut into `PIECE` code points before
parts of them are taken, so the cost of a text with very many matches stays near its length. Patterns use possessive repeats and look-behinds
that change no match but keep long runs linear.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, sorted by start and kind; rows are kept
one to one, whatever their ids. Base spans (email, ip, card, phone) always stay; the method adds cards inside longer digit
runs (Luhn), IBANs (mod-97), and secrets and national phone numbers that a word nearby vouches for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the patterns, in the order in which kinds are listed
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # a run with fewer digits cannot pass
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
INNER_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"
#: fixed values: length of an IBAN by country; codes without a known length may have any
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?:%s|(?!%s)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])" % (
    "|".join(r"(?:%s)[0-9]{2}(?:\x20?[A-Z0-9]){%d}" % (c.replace(" ", "|"), n - 4) for n, c in IBAN_LENGTHS.items()),
    "|".join(" ".join(IBAN_LENGTHS.values()).split()))
IBAN_START = r"(?<![A-Za-z0-9])[A-Z]{2}(?=[0-9]{2}\x20?[A-Z0-9])"
IBAN_REACH = 68
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
LOCAL_PHONE = r"(?<![0-9+A-Za-z])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
#: fixed values: score of a bare pattern, of one that its checksum confirms, and what a context word adds
BARE, CONFIRMED, NEARBY, ACCEPT = 0.4, 0.8, 0.2, 0.6
REACH = 40
CONTEXT = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|master|amex|pay|credit",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
    "secret": "token|secret|passw|api.?key|access.?key|credential|bearer",
}

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double,text:string>>"


#: matches a running sum takes in one go; code points of a piece of text, and pieces of a larger cut
BLOCK, PIECE, CUT = 256, 1024, 64


def _running(items: Column, start: Column, move, emit, kind: str) -> Column:
    """Array of emit(state, item) over `items`, the state going from `start` by move(state, item).

    An array grows by copying, so items are taken in blocks: each block grows an array of its own, and those are joined at the end.
    """
    fresh = lambda state: F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        return F.struct(move(acc["state"], x).alias("state"), F.array_append(acc["out"], emit(acc["state"], x)).alias("out"))

    def whole(v: Column) -> Column:
        def many(acc: Column, k: Column) -> Column:
            block = F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), fresh(acc["state"]), one)
            grown = lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out"))
            return F.get(F.transform(F.array(block), grown), F.lit(0))

        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / BLOCK).cast("int"), F.lit(1)) - 1)
        outer = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(places, outer, many, lambda acc: acc["out"]))

    return F.get(F.transform(F.array(items), whole), F.lit(0))  # what stands in a lambda's variable is worked out once


def _places(text: Column, pattern: str, gate: Column, ahead: int = REACH) -> Column:
    """start, end, text, REACH code points before and `ahead` after of every leftmost match that does not overlap an earlier one."""
    kind = "struct<start:int,end:int,text:string,before:string,after:string>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def back(head: Column, x: Column) -> Column:
        return F.left(F.concat(F.left(x["gap"], F.lit(ahead)), F.left(x["hit"], F.lit(ahead)), head), F.lit(ahead))

    after = F.reverse(_running(F.reverse(pairs), F.left(F.element_at(between, -1), F.lit(ahead)), back, lambda head, x: head, "string"))
    both = F.zip_with(pairs, after, lambda p, rest: F.struct(p.alias("p"), rest.alias("after")))
    before = lambda state, x: F.right(F.concat(state["tail"], F.right(x["p"]["gap"], F.lit(REACH))), F.lit(REACH))

    def move(state: Column, x: Column) -> Column:
        at = state["at"] + F.char_length(x["p"]["gap"]) + F.char_length(x["p"]["hit"])
        return F.struct(at.alias("at"), F.right(F.concat(before(state, x), F.right(x["p"]["hit"], F.lit(REACH))), F.lit(REACH)).alias("tail"))

    def emit(state: Column, x: Column) -> Column:
        at = state["at"] + F.char_length(x["p"]["gap"])
        return F.struct(at.alias("start"), (at + F.char_length(x["p"]["hit"])).alias("end"), x["p"]["hit"].alias("text"),
                        before(state, x).alias("before"), x["after"].alias("after"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    return F.when(gate & F.rlike(text, F.lit(pattern)), _running(both, start, move, emit, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def _ibans(text: Column, gate: Column) -> Column:
    """Places of what has the form of an IBAN, tried at every start, as long as its country says."""
    full = lambda x: F.regexp_extract(F.concat(x["text"], x["after"]), f"^{IBAN}", 0)
    named = F.transform(_places(text, IBAN_START, gate, IBAN_REACH), lambda x: x.withField("text", full(x)))
    return F.transform(F.filter(named, lambda x: x["text"] != ""), lambda x: x.withField("end", x["start"] + F.char_length(x["text"])))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without blanks passes the mod-97 check (letters count 10 to 35)."""
    turned = F.concat(F.substring(code, 5, 1000), F.substring(code, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        n = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(turned), F.lit(1))), F.lit(0), add) == 1


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _scored(places: Column, kind: str, valid, base: float) -> Column:
    """Places that pass `valid`, as spans with a score: `base`, more if a context word stands near it, before or after."""
    near = lambda x: F.lower(F.concat(x["before"], F.lit("\n"), F.left(x["after"], F.lit(REACH)))).rlike(CONTEXT[kind])
    return F.transform(
        F.filter(places, valid),
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"),
            F.least(F.lit(base) + F.when(near(x), NEARBY).otherwise(0.0), F.lit(1.0)).alias("score"), x["text"].alias("text"),
        ),
    ).cast(_SPAN)


def _ip_ok(x: Column) -> Column:
    small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(x["text"], r"\."), lambda p: (F.char_length(small(p)) <= 3) & (F.right(small(p), F.lit(3)).cast("int") <= 255))


def spans(docs: DataFrame, *keep: str) -> DataFrame:
    """Each row's `keep` columns and text with `base` and `added`: arrays of start, rank, end, kind, score, text."""
    text = F.col("text")
    df = docs.select(*keep, F.coalesce(text, F.lit("")).alias("text"))
    df = df.withColumn("has_digit", F.rlike(text, F.lit("[0-9]")))
    digit = F.col("has_digit")
    df = df.select(
        *keep, "text",
        _places(text, EMAIL, F.contains(text, F.lit("@"))).alias("p_email"),
        _places(text, IP, digit & F.contains(text, F.lit("."))).alias("p_ip"),
        _places(text, CARD, digit).alias("p_card"),
        _places(text, PHONE, digit & F.contains(text, F.lit("+"))).alias("p_phone"),
        _places(text, INNER_CARD, digit).alias("p_inner"),
        _ibans(text, digit).alias("p_iban"),
        _places(text, SECRET, digit).alias("p_secret"),
        _places(text, LOCAL_PHONE, digit).alias("p_local"),
    )
    count = lambda x: F.char_length(_digits(x["text"]))
    ok_card = lambda x: count(x).between(14, 19) & luhn(_digits(x["text"]))
    base = F.concat(
        _scored(F.col("p_email"), "email", lambda x: F.lit(True), CONFIRMED),
        _scored(F.col("p_ip"), "ip", _ip_ok, CONFIRMED),
        _scored(F.col("p_card"), "card", ok_card, CONFIRMED),
        _scored(F.col("p_phone"), "phone", lambda x: count(x).between(10, 15), CONFIRMED),
    )
    more = F.concat(
        _scored(F.col("p_inner"), "card", lambda x: luhn(_digits(x["text"])), CONFIRMED),
        _scored(F.col("p_iban"), "iban", lambda x: mod97(F.replace(x["text"], F.lit(" "), F.lit(""))), CONFIRMED),
        _scored(F.col("p_secret"), "secret", lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]"), BARE),
        _scored(F.col("p_local"), "phone", lambda x: F.lit(True), BARE),
    )
    df = df.select(*keep, "text", F.sort_array(base).alias("base"), F.filter(more, lambda x: x["score"] >= ACCEPT).alias("more"))
    added = F.concat(*[_apart(_of("base", k), _of("more", k)) if k in KINDS[:4] else _of("more", k) for k in KINDS])
    return df.select(*keep, "text", "base", F.sort_array(added).alias("added"))


def _of(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def _apart(base: Column, more: Column) -> Column:
    """The spans of `more` that overlap none of `base`: in one pass from the left and one from the right over both."""
    shape = _SPAN[len("array<"):-1]
    tagged = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.lit(own).alias("own"), x.alias("x")))
    every = F.sort_array(F.concat(tagged(base, 0), tagged(more, 1)))
    right = _running(
        every, F.lit(0), lambda end, t: F.when(t["own"] == 0, F.greatest(end, t["x"]["end"])).otherwise(end),
        lambda end, t: F.struct(t["own"].alias("own"), t["x"].alias("x"), (t["x"]["start"] < end).alias("hit")), f"struct<own:int,x:{shape},hit:boolean>")
    left = _running(
        F.reverse(right), F.lit((1 << 31) - 1), lambda start, t: F.when(t["own"] == 0, F.least(start, t["x"]["start"])).otherwise(start),
        lambda start, t: F.struct(t["own"].alias("own"), t["x"].alias("x"), (t["hit"] | (t["x"]["end"] > start)).alias("hit")),
        f"struct<own:int,x:{shape},hit:boolean>")
    free = F.transform(F.filter(left, lambda t: (t["own"] == 1) & ~t["hit"]), lambda t: t["x"])
    return F.when((F.size(base) > 0) & (F.size(more) > 0), free).otherwise(more)


def listed(found: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def pieces(text: Column) -> Column:
    """`text` in pieces of PIECE code points (the last ones shorter or empty), cut twice so that no cut starts far from a beginning."""
    wide = PIECE * CUT
    large = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(text) / wide).cast("int"), F.lit(1)) - 1),
                        lambda k: F.substring(text, k * wide + 1, F.lit(wide)))
    return F.flatten(F.transform(large, lambda b: F.transform(F.sequence(F.lit(0), F.lit(CUT - 1)), lambda j: F.substring(b, j * PIECE + 1, F.lit(PIECE)))))


def _part(cut: str, a: Column, b: Column) -> Column:
    """Code points a to b of a text from its pieces."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    return F.when(a >= b, "").when(i == j, F.substring(F.get(cut, i), a % PIECE + 1, b - a)).otherwise(F.concat(
        F.substring(F.get(cut, i), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(cut, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
        F.coalesce(F.substring(F.get(cut, j), F.lit(1), b % PIECE), F.lit(""))))


def redacted(text: Column, cut: str, found: Column) -> Column:
    """`text` (its pieces in the column `cut`) with each span replaced by its kind in brackets; spans that overlap an earlier one widen it."""
    def piece(at: Column, x: Column) -> Column:
        return F.when(x["start"] >= at, F.concat(_part(cut, at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

    masked = _running(found, F.lit(0), lambda at, x: F.greatest(at, x["end"]), piece, "string")
    last = F.array_max(F.transform(found, lambda x: x["end"]))
    return F.when(F.size(found) > 0, F.concat(F.array_join(masked, ""), _part(cut, last, F.char_length(text)))).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with all its columns, the text redacted (null stays null) and n_chars, if it is there, counted anew."""
    names = docs.columns
    found = spans(docs.select(F.struct(*names).alias("row"), "text"), "row")
    found = found.select("row", "text", F.sort_array(F.concat("base", "added")).alias("found"))
    found = found.select("row", "text", "found", F.when(F.size("found") > 0, pieces(F.col("text"))).alias("cut"))
    found = found.select("row", F.when(F.col("row.text").isNotNull(), redacted(F.col("text"), "cut", F.col("found"))).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text").cast("long"), F.col("row")["n_chars"] if "n_chars" in names else F.lit(None))}
    return found.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in names])


def counts(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans: the contract's columns."""
    df = spans(docs, "doc_id")
    everything = F.sort_array(reduce(F.concat, [F.col("base"), F.col("added")]))
    return df.select(
        "doc_id", *[counts(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(everything).alias("spans"),
    )
