"""Operator 3, PII: bootstrapped contextual extraction, in DataFrame functions only.

Four patterns find the base entities (email, ip, card, phone) with their places in code points.  Every other token with a digit or
an ``@`` is a candidate.  Each has three lexical patterns: the word before it, this word with the token's shape (letters run
together, digits as 9), and the word after it with the shape.  Patterns and the tokens that they meet make a graph: base entities are seeds that
are believed, a pattern is as good for a kind as the share of its distinct tokens that is believed to be of that kind, a token
is believed as far as its patterns together say (noisy or), and so on for ``TURNS`` turns.  A pattern is trusted with a score
of at least ``TRUST`` and ``SUPPORT`` distinct believed tokens, be they seeds or found in an earlier turn, so what is found makes
further patterns known.  Trusted patterns mark the candidates that they meet, the best one saying the kind.  What has a kind's
whole form and failed its test (a number with a wrong check digit) is refuted: no pattern makes it of this kind.

The patterns are possessive and begin only where a run begins (or a match ended), so time is linear in the text; runs of
matches are gathered in blocks, so it stays so for texts full of matches.

Defined results: null and empty texts have no spans; matches that fail a kind's test are dropped and not tried again;
spans of different kinds may overlap; repeated rows have equal results; an empty table gives an empty result; further
columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, fresh

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that they cannot go back over what they took.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Turns of the graph; a trusted pattern's least share and distinct believed tokens; matches in a block; characters of context.
TURNS, TRUST, SUPPORT, BLOCK, BEFORE = 3, 0.5, 5, 256, 64
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_EDGE = ".,;:!?()[]{}<>\"''|"
_SPAN = "array<struct<s:int,e:int,ctx:array<string>,token:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled."""
    numbers = F.reverse(F.filter(F.split(digits, ""), lambda x: x != ""))
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(numbers, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # A part beyond nine digits after its zeros is above 255 whatever it is.
        return F.forall(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def _places(text: Column, pattern: str, kind: str, row) -> Column:
    """An array with ``row(start, match, gap before, gap after, whether it is the first)`` for each match that passes."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # The arrays are made once for a text; the gap after the last match has no match, and no row.
    items = F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    items = F.zip_with(items, F.slice(gaps, F.lit(2), F.size(gaps)), lambda x, after: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), after.alias("after")))
    empty = F.lit(None).cast(kind)
    none = F.array().cast(kind)
    start = F.struct(F.lit(0).alias("at"), none.alias("now"), F.array().cast(f"array<{kind}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        one = row(s, x["m"], x["gap"], x["after"], acc["at"] == 0)
        now = F.when(one.isNull(), acc["now"]).otherwise(F.concat(acc["now"], F.array(one)))
        full = F.size(acc["now"]) >= BLOCK
        return F.struct(
            (s + F.length(x["m"])).alias("at"),
            F.when(full, F.when(one.isNull(), none).otherwise(F.array(one))).otherwise(now).alias("now"),
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
        )

    whole = F.aggregate(items, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
    return F.coalesce(whole, empty, none)


def _before(gap: Column, first: Column) -> Column:
    """The word before: one that is an identifier itself counts as ``<id>``, one of more than BEFORE characters by its end."""
    word = F.lower(F.regexp_extract(F.right(gap, F.lit(BEFORE)), r"(\S+)\s+$", 1))
    return F.when((word != "") & ~word.rlike("[0-9@]"), word).when((word == "") & first, F.lit("<start>")).otherwise(F.lit("<id>"))


def _after(gap: Column) -> Column:
    """The word after, without the signs behind it; ``<id>`` where another match comes first, ``<end>`` where nothing does."""
    word = F.rtrim(F.lower(F.regexp_extract(F.left(gap, F.lit(BEFORE)), r"^[^\s\w]*\s+(\S+)", 1)), F.lit(_EDGE))
    return F.when((word != "") & ~word.rlike("[0-9@]"), word).when(F.length(gap) == 0, F.lit("<end>")).otherwise(F.lit("<id>"))


def _shape(token: Column) -> Column:
    """Runs of letters as one a or A, each digit as 9; of more than BEFORE characters the first."""
    letters = F.regexp_replace(F.regexp_replace(F.left(token, F.lit(BEFORE)), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    return F.translate(letters, "012345678", "999999999")


def _patterns(token: Column, gap: Column, after: Column, first: Column) -> Column:
    """The patterns that a token meets: the word before, this with the shape, the word after with the shape."""
    shape, before = _shape(token), _before(gap, first)
    return F.array(F.concat(F.lit("before "), before), F.concat_ws(" ", F.lit("both"), before, shape), F.concat_ws(" ", F.lit("after"), _after(after), shape))


def _span_row(kind: str):
    def row(s: Column, m: Column, gap: Column, after: Column, first: Column) -> Column:
        span = F.struct(s.cast("int").alias("s"), (s + F.length(m)).cast("int").alias("e"), _patterns(m, gap, after, first).alias("ctx"), m.alias("token"))
        return F.when(m.isNotNull() & _passes(kind, m), span)

    return row


def _candidate_row(s: Column, m: Column, gap: Column, after: Column, first: Column) -> Column:
    """A token without the signs around it."""
    left = F.ltrim(m, F.lit(_EDGE))
    bare = F.rtrim(left, F.lit(_EDGE))
    begin = s + F.length(m) - F.length(left)
    span = F.struct(begin.cast("int").alias("s"), (begin + F.length(bare)).cast("int").alias("e"), _patterns(bare, gap, after, first).alias("ctx"), bare.alias("token"))
    return F.when(F.length(bare) > 0, span)


def _refuted(token: Column) -> Column:
    """The kind whose form a candidate has, without having passed its test; null for most."""
    # Character classes only: a repeated group would go one step deeper for each digit.
    forms = (("ip", r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), ("card", r"^(?!.*--)[0-9][0-9-]*[0-9]$"), ("phone", r"^\+[0-9][().0-9-]+[0-9]$"))
    out = F.lit(None).cast("string")
    for kind, form in forms:
        out = F.when(token.rlike(form), F.lit(kind)).otherwise(out)
    return out


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind, from left to right."""
    has_digit = text.rlike("[0-9]")
    guard = {"email": F.instr(text, "@") > 0, "ip": has_digit, "card": has_digit, "phone": F.instr(text, "+") > 0}
    return {k: F.when(guard[k], _places(text, PATTERNS[k], _SPAN, _span_row(k))).otherwise(F.array().cast(_SPAN)) for k in KINDS}


def candidates(text: Column) -> Column:
    return F.when(text.rlike("[0-9@]"), _places(text, _CANDIDATE, _SPAN, _candidate_row)).otherwise(F.array().cast(_SPAN))


def _meets(kind: str, c: Column) -> Column:
    return F.exists(kind, lambda x: (x["s"] < c["e"]) & (x["e"] > c["s"]))


def _rows(scanned: DataFrame) -> DataFrame:
    """uid, s, e, ctx, token, kind: base entities with their kind, and the candidates that meet none of them, once for each pattern."""
    base = F.concat(*(F.transform(k, _with_kind(k)) for k in KINDS))
    others = F.transform("cands", _with_kind(None))
    for k in KINDS:
        others = F.when(F.size(k) == 0, others).otherwise(F.filter(others, _apart(k)))
    return scanned.select("uid", F.explode(F.concat(base, others)).alias("c")).select("uid", "c.s", "c.e", F.explode("c.ctx").alias("ctx"), "c.token", "c.kind")


def _with_kind(kind: str | None):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["ctx"].alias("ctx"), x["token"].alias("token"), F.lit(kind).cast("string").alias("kind"))


def _apart(kind: str):
    return lambda c: ~_meets(kind, c)


def trusted_patterns(rows: DataFrame) -> DataFrame:
    """ctx, score, kind: patterns that tell a kind, by scoring the graph of patterns and tokens for ``TURNS`` turns."""
    edges = cut(rows.groupBy("ctx", "token").agg(F.max("kind").alias("kind")).withColumn("refuted", F.when(F.col("kind").isNull(), _refuted(F.col("token")))), "pii-edges")
    degree = edges.groupBy("ctx").agg(F.count("*").alias("n"))
    seeds = edges.where("kind is not null").select("token", "kind").distinct().withColumn("belief", F.lit(1.0))
    belief, score = seeds, None
    for _ in range(TURNS):
        sums = edges.select("ctx", "token").join(belief, "token").groupBy("ctx", "kind").agg(F.sum("belief").alias("sum"), F.sum((F.col("belief") >= TRUST).cast("long")).alias("support"))
        score = sums.where(F.col("support") >= SUPPORT).join(degree, "ctx").withColumn("score", F.col("sum") / (F.col("n") + 1)).where(F.col("score") >= TRUST)
        score = cut(score.select("ctx", "kind", "score"), "pii-score")
        told = edges.select("ctx", "token", "refuted").join(score, "ctx").where("not refuted <=> kind").groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("belief"))
        belief = cut(told.unionByName(seeds).groupBy("token", "kind").agg(F.max("belief").alias("belief")), "pii-belief")
    return score.groupBy("ctx").agg(F.max(F.struct("score", "kind")).alias("x")).select("ctx", "x.score", "x.kind")


def _scan(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The documents with a row number, their base spans and candidates, written once; ``keep`` columns stay."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("uid"), *(F.col(f"`{c}`").alias(f"k_{c}") for c in keep), *(x.alias(k) for k, x in base_spans(text).items()), candidates(text).alias("cands"))


def _found(scanned: DataFrame) -> DataFrame:
    """uid, added: the spans that patterns add, by kind and start."""
    rows = cut(_rows(scanned), "pii-rows")
    marked = rows.where("kind is null").drop("kind").join(trusted_patterns(rows), "ctx")
    best = marked.where(~_refuted(F.col("token")).eqNullSafe(F.col("kind"))).groupBy("uid", "s", "e").agg(F.max(F.struct("score", "kind")).alias("x"))
    return best.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("x.kind", "s", "e"))).alias("added"))


def _place(x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"))


def _of(kind: str, added: Column) -> Column:
    return F.transform(F.filter(F.coalesce(added, F.array().cast("array<struct<kind:string,s:int,e:int>>")), lambda x: x["kind"] == kind), _place)


def _said(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def _named(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind.upper()).alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the spans of each kind in the base, and ``added`` (kind, s, e) by patterns."""
    scanned = cut(_scan(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", ["doc_id"]), "pii-scan")
    return scanned.drop("cands").join(_found(scanned), "uid", "left").select(F.col("k_doc_id").alias("doc_id"), *KINDS, "added")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    base = F.concat_ws(",", F.concat(*(_said(k, F.col(k)) for k in KINDS)))
    every = F.concat_ws(",", F.concat(*(_said(k, F.array_sort(F.array_union(F.transform(k, _place), _of(k, F.col("added"))))) for k in KINDS)))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span in the text, base or added, replaced by its kind in brackets; spans that overlap are one.

    A text without spans, null included, stays as it is; where one is changed, ``length_col`` (if there) follows.
    """
    scanned = cut(_scan(docs, text_col, docs.columns), "pii-scan")
    rows = scanned.drop("cands").join(_found(scanned), "uid", "left")
    text = F.col(f"k_{text_col}")
    named = [F.transform(F.concat(F.transform(k, _place), _of(k, F.col("added"))), _named(k)) for k in KINDS]
    spans = F.array_sort(F.concat(*named))
    rows = rows.withColumn("spans", spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        add = F.array(F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], add)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
    changed = F.size("spans") > 0
    out = fresh(rows, "clean")
    rows = rows.withColumn(out, F.when(changed, clean).otherwise(text))
    columns = []
    for name, kind in docs.dtypes:
        if name == text_col:
            columns.append(F.col(out).cast(kind).alias(name))
        elif name == length_col:
            columns.append(F.when(changed, F.length(out)).otherwise(F.col(f"k_{name}")).cast(kind).alias(name))
        else:
            columns.append(F.col(f"k_{name}").alias(name))
    return rows.select(*columns)
