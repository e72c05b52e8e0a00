"""Personal data by patterns and bootstrapped context, in DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They seed a bootstrap: every identifier-shaped
word or run of number words of the corpus is an instance, and the words around it are lexical patterns: two words before
and one after, the two before, the one before, the one after; marks stand for the text's start and end. Over the graph of
patterns and instances, a pattern's confidence in a kind is the share of its distinct instances already believed to be of
that kind, and an instance is believed as far as its best pattern is and its shape agrees: a shape that mostly occurs
elsewhere lowers the odds. Rounds go on until no belief changes. Confident patterns add what the base patterns missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import staged, table, unstage

KINDS = ("email", "ip", "card", "phone")
_WS = r"\x20\x09-\x0D"
_LOCAL = "A-Za-z0-9._%+-"
# The anchors only keep a failed run from being tried again from each of its characters.
_REGEX = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MARKED = r"[0-9@]|\p{L}[\[({]"
#: Number words with spaces between them, else one word with a digit, an @ or a bracket after a letter.
_NUMBERS = rf"[+(]*+[0-9][0-9()-]*\x20[0-9()\x20-]*[0-9](?=[^{_WS}\p{{L}}0-9]*+(?:[{_WS}]|\z))"
_WORD = rf"(?<![^{_WS}])(?:{_NUMBERS}|(?=[^{_WS}]*?(?:{_MARKED}))[^{_WS}]++)"
#: Marks of a text's start and end in contexts.
_START, _END = "\x02", "\x03"
#: A pattern needs this many distinct believed instances, this confidence, and an instance this score. A shape divides odds by LOWERED at most.
SUPPORT, CONFIDENCE, SCORE, LOWERED = 3, 0.9, 0.9, 4
#: Up to so many pairs of words and base spans a row's own arrays are compared; beyond it, cells of so many code points are joined.
PAIRS, CELL = 1 << 14, 64


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x):
    d = F.reverse(_digits(x))
    one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    two = lambda i: F.when(i % 2 == 1, one(i)).otherwise(2 * one(i) - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), two), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, x):
    if kind == "ip":
        return x.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.|$)){4}")
    n = F.length(_digits(x))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(x)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _located(text, regex: str, keep, item, fields: str, context: bool = False):
    """Array of item(start, match, piece before, piece after) (`fields`) of the leftmost matches that `keep` holds for; places are code points.

    Matches and the pieces between them alternate, so running lengths give the places. With `context`, the piece before
    begins with the word and match before it, or the start mark, and the piece after ends with the next match, or the end mark.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    both = F.zip_with(both, F.slice(pieces, 2, F.greatest(F.size(found), F.lit(1))), lambda b, q: F.struct(b["p"].alias("p"), b["m"].alias("m"), q.alias("q")))
    if context:
        after = F.concat(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.lit(f" {_END}")))
        both = F.zip_with(both, after, lambda b, m: F.struct(b["p"].alias("p"), b["m"].alias("m"), F.concat(b["q"], m).alias("q")))
        both = F.filter(both, lambda b: b["m"].isNotNull())
    # One pass keeps the place beside the list. Lists grow by copying, so they are built in blocks.
    n = 256
    count = lambda w: F.greatest(F.ceil(F.size(w) / n), F.lit(1)).cast("int")
    blocks = F.transform(F.array(both), lambda w: F.transform(F.sequence(F.lit(1), count(w)), lambda i: F.slice(w, (i - 1) * n + 1, n)))[0]

    def add(a, b):
        at = a["to"] + F.length(b["p"])
        seen = {"p": F.concat(a["tail"], b["p"]), "m": b["m"], "q": b["q"]} if context else b
        out = F.when(keep(b["m"]), F.concat(a["out"], F.array(item(at, seen)))).otherwise(a["out"])
        tail = [F.concat(F.regexp_extract(seen["p"], rf"(?<![^{_WS}])[^{_WS}]++[{_WS}]++\z", 0), b["m"]).alias("tail")] if context else []
        return F.struct((at + F.length(b["m"])).alias("to"), out.alias("out"), *tail)

    def block(a, part):
        tail = [a["tail"].alias("tail")] if context else []
        begin = F.struct(a["to"].alias("to"), F.array().cast(f"array<struct<{fields}>>").alias("out"), *tail)
        kept = lambda r: [r["tail"].alias("tail")] if context else []
        return F.aggregate(part, begin, add, lambda r: F.struct(r["to"].alias("to"), F.concat(a["out"], F.array(r["out"])).alias("out"), *kept(r)))

    tail = [F.lit(f"{_START} ").alias("tail")] if context else []
    start = F.struct(F.lit(0).alias("to"), F.array().cast(f"array<array<struct<{fields}>>>").alias("out"), *tail)
    return F.aggregate(blocks, start, block, lambda a: F.flatten(a["out"]))


def _base(kind: int):
    text = F.col("text")
    gate = {"email": text.contains("@"), "phone": text.contains("+")}.get(KINDS[kind], text.rlike("[0-9]"))
    item = lambda at, b: F.struct(F.lit(kind).alias("k"), at.alias("s"), (at + F.length(b["m"])).alias("e"))
    spans = _located(text, _REGEX[KINDS[kind]], lambda m: _valid(KINDS[kind], m), item, "k:int,s:int,e:int")
    return F.when(gate, spans).otherwise(F.array().cast("array<struct<k:int,s:int,e:int>>"))


def _shape(x):
    return F.regexp_replace(F.regexp_replace(x, r"\p{L}+", "a"), "[0-9]", "9")


def _plain(context):
    spaced = F.trim(F.regexp_replace(F.lower(context), rf"[{_WS}]+", " "))
    return F.regexp_replace(F.regexp_replace(spaced, rf"[^\p{{L}}0-9 :=#{_START}{_END}]", ""), "[0-9]+", "9")


def _words():
    """Identifier-shaped words and runs of number words: place, end, the match without outer punctuation, two words before and one after."""
    text = F.col("text")

    def item(at, b):
        # A bracketed number that another follows, as in (555) 010, keeps its bracket.
        outer = r"^(?!\([0-9]+\)[\x20-]?[0-9])[^\p{L}0-9+]+"
        lead = F.length(F.regexp_extract(b["m"], outer, 0))
        bare = F.regexp_replace(F.regexp_replace(b["m"], outer, ""), r"[^\p{L}0-9]+$", "")
        left = _plain(F.regexp_extract(b["p"], rf"(?<![^{_WS}])(?:[^{_WS}]++[{_WS}]++){{1,2}}\z", 0))
        right = _plain(F.regexp_extract(b["q"], rf"^[^{_WS}]*+[{_WS}]++([^{_WS}]++)", 1))
        return F.struct((at + lead).alias("s"), (at + lead + F.length(bare)).alias("e"), bare.alias("x"), left.alias("left"), right.alias("right"))

    fields = "s:int,e:int,x:string,left:string,right:string"
    return F.when(text.rlike(_MARKED), _located(text, _WORD, lambda m: F.lit(True), item, fields, True)).otherwise(F.array().cast(f"array<struct<{fields}>>"))


def _joined(spans):
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), s["s"].cast("string"), s["e"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), named), ",")


def base_spans(docs: DataFrame, *more: str) -> DataFrame:
    """`docs` (doc_id, text, ...) as doc_id, columns `more`, `base` (spans k, s, e by kind, then place) and `words`."""
    text = docs.withColumn("text", F.coalesce("text", F.lit("")))
    base = F.concat(*[_base(k) for k in range(len(KINDS))])
    return text.select("doc_id", *more, base.alias("base"), _words().alias("words"))


def _uses(found: DataFrame) -> DataFrame:
    """(rid, s, e, x, left, right, k) of every word; k: kind of the first base span (by kind, then place) that it overlaps."""
    rows = found.where(F.size("words") > 0).select("rid", "base", "words")
    many = F.size("base").cast("long") * F.size("words") > PAIRS
    facts, real = [F.col(f"w.{c}").alias(c) for c in ("s", "e", "x", "left", "right")], "x <> '' and s < e"
    hits = F.filter("base", lambda b: (b["s"] < F.col("w.e")) & (b["e"] > F.col("w.s")))
    few = rows.where(~many).select("rid", "base", F.explode("words").alias("w")).select("rid", *facts, F.get(hits, F.lit(0))["k"].alias("k")).where(real)
    words = rows.where(many).select("rid", F.explode("words").alias("w")).select("rid", *facts).where(real)
    spans = rows.where(many).select(F.col("rid").alias("_rid"), F.explode("base").alias("b")).select("_rid", F.col("b.k").alias("k"), F.col("b.s").alias("_s"), F.col("b.e").alias("_e"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL)))
    met = words.select("rid", "s", "e", cells("s", "e").alias("cell")).join(spans.withColumn("_cell", cells("_s", "_e")), (F.col("rid") == F.col("_rid")) & (F.col("cell") == F.col("_cell")) & (F.col("_s") < F.col("e")) & (F.col("_e") > F.col("s")))
    first = met.groupBy("rid", "s", "e").agg(F.min(F.struct("k", "_s"))["k"].alias("k"))
    return few.unionByName(words.join(first, ["rid", "s", "e"], "left"))


def bootstrapped(found: DataFrame) -> DataFrame:
    """(rid, k, s, e): spans that confident patterns add to the rows of `found` (rid, base, words)."""
    uses = staged(_uses(found), "uses")
    around = [F.concat_ws("|", "left", "right"), F.concat("left", F.lit("|*")), F.concat(F.lit("* "), F.substring_index("left", " ", -1), F.lit("|*")), F.concat(F.lit("*|"), "right")]
    placed = uses.withColumn("p", F.explode(F.array(*around)))
    linked = staged(placed.groupBy("p", "x").agg(F.max("k").alias("k")), "links")
    total = linked.groupBy("p").agg(F.count("*").alias("n")).where(f"n >= {SUPPORT}")
    edges = staged(linked.join(total, "p"), "graph")
    unstage(linked)
    seeds = staged(uses.where("k is not null").select("x", "k").distinct().withColumn("score", F.lit(1.0)), "seeds")
    shapes = staged(uses.select("x").distinct().groupBy(_shape(F.col("x")).alias("shape")).agg(F.count("*").alias("of")), "shapes")
    known = seeds.select("x").distinct()
    belief, patterns, size = staged(seeds, "belief"), None, None
    while True:
        last, spent = belief, patterns
        support = edges.select("p", "x", "n").join(belief, "x").groupBy("p", "k").agg(F.sum("score").alias("mass"), F.count("*").alias("m"), F.max("n").alias("n"))
        patterns = staged(support.where(f"m >= {SUPPORT}").withColumn("conf", F.col("mass") / F.col("n")).where(f"conf >= {CONFIDENCE}").select("p", "k", "conf"), "patterns")
        best = edges.where("k is null").select("p", "x").join(patterns, "p").groupBy("x", "k").agg(F.max("conf").alias("conf"))
        best = staged(best.join(known, "x", "left_anti").withColumn("shape", _shape(F.col("x"))), "best")
        inside = seeds.select("k", _shape(F.col("x")).alias("shape")).unionByName(best.select("k", "shape")).groupBy("shape", "k").agg(F.count("*").alias("in"))
        odds = F.greatest((F.col("in") + 1) / (F.col("of") + 1), F.lit(1 / LOWERED)) * F.col("conf")
        new = best.join(inside, ["shape", "k"]).join(shapes, "shape").select("x", "k", (odds / (odds + 1 - F.col("conf"))).alias("score")).where(f"score >= {SCORE}")
        # Scores only rise from round to round; in thousandths they can't do so for ever, and equal sums are equal beliefs.
        belief = staged(seeds.unionByName(new.withColumn("score", F.floor(F.col("score") * 1000 + 1e-6) / 1000)), "belief")
        for old in (last, best, spent):
            if old is not None:
                unstage(old)
        now = belief.agg(F.count("*"), F.sum(F.round(F.col("score") * 1000).cast("long"))).first()
        if now == size:
            break
        size = now
    placed = placed.where("k is null").drop("k").join(patterns.select("p", F.col("k").alias("pk"), "conf"), "p")
    believed = belief.select("x", F.col("k").alias("pk"))
    best = F.max(F.struct("conf", (-F.col("pk")).alias("k")))["k"]
    return placed.join(believed, ["x", "pk"]).groupBy("rid", "s", "e").agg((-best).alias("k")).select("rid", "k", "s", "e")


def _of(kind: int):
    return lambda span: span["k"] == kind


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_<kind> and base_sha256 of the base patterns' spans, spans with the method's own.

    Spans are kind:start:end in code points, by kind, then start. Null text counts as empty; rows are independent, so
    repeated and null ids stay as they are.
    """
    found = staged(base_spans(docs).withColumn("rid", F.monotonically_increasing_id()), "found")
    more = bootstrapped(found).groupBy("rid").agg(F.collect_list(F.struct("k", "s", "e")).alias("more"))
    out = found.join(more, "rid", "left")
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>")))
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in brackets; of overlapping spans the first, then longest."""
    keyed = staged(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")), "keyed")
    found = staged(base_spans(keyed.select("rid", "row.doc_id", "row.text"), "rid"), "found")
    more = bootstrapped(found).groupBy("rid").agg(F.collect_list(F.struct("k", "s", "e")).alias("more"))
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>")))
    order = F.array_sort(F.transform(every, lambda s: F.struct(s["s"].alias("s"), (-s["e"]).alias("e"), s["k"].alias("k"))))
    spans = found.join(more, "rid", "left").select("rid", order.alias("spans"))
    text = F.coalesce("row.text", F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a, s):
        put = F.concat(a["out"], F.substring(text, a["at"] + 1, s["s"] - a["at"]), F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), F.lit("]"))
        return F.when(s["s"] >= a["at"], F.struct((-s["e"]).alias("at"), put.alias("out"))).otherwise(a)

    clean = F.aggregate("spans", start, add, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    put = F.when(F.col("row.text").isNotNull(), clean)
    return keyed.join(spans, "rid").select(F.col("row").withField("text", put).alias("row")).select("row.*")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
