"""Personal data in texts: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Everything is DataFrame functions. The patterns are linear in the text: runs are taken possessively and tried from
their first character only, so that no run of letters or digits, however long, is scanned twice or piles up calls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: What the base spans match, written so that Java needs neither backtracking nor recursion.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

_SEP = r"[\x20._/-]{1,2}+"
#: Further generators: spelled-out addresses, numbers of a card's shape, phones without a plus, addresses with marked dots.
LOOSE = {
    EMAIL: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[(\[]\x20?[Aa][Tt]\x20?[)\]]\x20?|\x20[Aa][Tt]\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[(\[]\x20?[Dd][Oo][Tt]\x20?[)\]]\x20?|\x20[Dd][Oo][Tt]\x20|\.)[A-Za-z0-9-]{1,63}+)++",
    IP: r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}+){3}(?![0-9.])",
    CARD: rf"(?<![0-9A-Za-z])(?:[0-9]{{14,19}}+|[0-9]{{4}}{_SEP}(?:[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{1,7}}+|[0-9]{{6}}{_SEP}[0-9]{{5}}))(?![0-9A-Za-z])",
    PHONE: r"(?<![0-9A-Za-z+])(?:00\x20?|\+\x20?)?\(?[0-9]{1,4}+\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}+\)?){2,4}(?![0-9])",
}
#: Words that come before data of a kind.
CUES = {EMAIL: "mail|contact|write to", IP: r"\bip\b|host|server|address|login", CARD: "card|visa|credit|debit|amex|payment", PHONE: r"phone|\btel\b|call|fax|mobile|cell|dial"}
#: Code points before a span that are looked at for such words.
CONTEXT = 24

#: Boosting: trees, levels of a tree, step, and the weight that holds leaves near 0.
TREES, DEPTH, STEP, RIDGE = 6, 3, 0.8, 1.0
#: Share of base spans among held-out candidates above a kind's threshold; documents whose crc32 mod 4 is 2 are held out.
PRECISION = 0.95

FEATURES = ("kind", "digits", "runs", "longest", "shortest", "blanks", "dashes", "dots", "brackets", "plus", "letters", "at", "luhn", "octets", "left", "right", "cue", "last")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of at most 19 digits holds."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + k % 2))
    return F.aggregate(value, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def passes(kind: int, m: Column) -> Column:
    """What a base match must pass to count."""
    n = F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == CARD:
        return F.when((n >= 14) & (n <= 19), luhn(F.regexp_replace(m, "[^0-9]", ""))).otherwise(False)
    return (n >= 10) & (n <= 15)


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it: by blocks of about the square root of their number."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers))).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / width).cast("int")), lambda b: total(F.slice(numbers, b * width + 1, width)))
    let = F.array(F.struct(blocks.alias("b"), width.alias("w")))
    offsets = F.transform(let, lambda x: F.struct(F.transform(x["b"], lambda _, i: total(F.slice(x["b"], F.lit(1), i))).alias("o"), x["w"].alias("w")))
    each = F.transform(offsets, lambda x: F.transform(numbers, lambda _, i: F.get(x["o"], F.floor(i / x["w"]).cast("int")) + total(F.slice(numbers, F.floor(i / x["w"]).cast("int") * x["w"] + 1, i % x["w"]))))
    return F.get(each, F.lit(0))


def _beside(c: Column) -> Column:
    """Class of a neighbouring character: none or blank 0, opening mark 1, other mark 2, letter 3, digit 4."""
    return F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"[(\[{<\"'=:]"), 1).when(c.rlike(r"\p{L}"), 3).when(c.rlike("[0-9]"), 4).otherwise(2)


def _features(kind: int, x: Column) -> Column:
    """Small integers that describe a candidate's format and context; x has the match, its digits, runs and neighbours."""
    m, n = x["m"], F.char_length(x["d"])
    cap = lambda c, most: F.least(c, F.lit(most)).cast("int")
    has = lambda p: m.rlike(p).cast("int")
    sizes = F.transform(x["runs"], lambda r: F.char_length(r))
    cue = F.lit(0)
    for other, words in CUES.items():
        cue = F.when(x["before"].rlike(words), 2 if other == kind else 1).otherwise(cue) if other != kind else cue
    cue = F.when(x["before"].rlike(CUES[kind]), 2).otherwise(cue)
    small = F.forall(x["runs"], lambda r: r.rlike(f"^{OCTET}$"))
    return F.array(
        F.lit(kind), cap(n, 20), cap(F.size(x["runs"]), 8), cap(F.coalesce(F.array_max(sizes), F.lit(0)), 20), cap(F.coalesce(F.array_min(sizes), F.lit(0)), 8),
        has(r"\s"), has("-"), has(r"\."), has(r"[()\[\]]"), m.startswith("+").cast("int"), cap(F.char_length(m) - F.char_length(F.regexp_replace(m, r"[A-Za-z]", "")), 40),
        has("[^ ]@[^ ]"), F.when((n >= 12) & (n <= 19), luhn(x["d"]).cast("int")).otherwise(0), small.cast("int"), _beside(F.right(x["before"], F.lit(1))), _beside(x["after"]), cue, cap(F.char_length(F.substring_index(m, ".", -1)), 12),
    )


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, and spans: array of (kind, start, end, base, f) of all generators, in code points, end exclusive.

    base tells a match of a base pattern that passes its test. Texts are read once and leave the row only as spans.
    """
    generators = [(k, p, True) for k, p in BASE.items()] + [(k, p, False) for k, p in LOOSE.items()]
    out = df.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    number = F.col("t").rlike("[0-9]")
    may = {EMAIL: F.col("t").rlike("[@]|[Aa][Tt]"), IP: number, CARD: number, PHONE: number}
    may_base = may | {EMAIL: F.contains("t", F.lit("@")), PHONE: F.contains("t", F.lit("+"))}
    out = out.withColumns({f"m{g}": F.when((may_base if base else may)[k], F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none) for g, (k, p, base) in enumerate(generators)})
    out = out.withColumns({f"g{g}": F.when(F.size(f"m{g}") > 0, F.split("t", p, -1)).otherwise(none) for g, (_, p, _) in enumerate(generators)}).drop("t")
    out = out.withColumns({f"n{g}": F.zip_with(f"m{g}", F.slice(f"g{g}", 1, F.size(f"m{g}")), lambda m, a: F.char_length(m) + F.char_length(a)) for g in range(len(generators))})
    out = out.withColumns({f"s{g}": F.when(F.size(f"m{g}") > 0, sums_before(F.col(f"n{g}"))).otherwise(F.array().cast("array<int>")) for g in range(len(generators))})

    def described(g: int) -> Column:
        gaps = F.col(f"g{g}")
        both = F.zip_with(f"m{g}", f"s{g}", lambda m, s: F.struct(m.alias("m"), s.alias("s")))

        def one(x: Column, i: Column) -> Column:
            before = F.get(gaps, i)
            return F.struct(
                x["m"].alias("m"), (x["s"] + F.char_length(before)).alias("start"), F.lower(F.right(before, F.lit(CONTEXT))).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
                F.regexp_replace(x["m"], "[^0-9]", "").alias("d"), F.regexp_extract_all(x["m"], F.lit("[0-9]++"), F.lit(0)).alias("runs"),
            )

        return F.transform(both, one)

    out = out.withColumns({f"x{g}": described(g) for g in range(len(generators))})
    # runs of digits too short for the kind, such as a year, are no candidates
    least = {EMAIL: 0, IP: 4, CARD: 12, PHONE: 7}

    def span(kind: int, base: bool, x: Column) -> Column:
        end = x["start"] + F.char_length(x["m"])
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), end.alias("end"), (passes(kind, x["m"]) if base else F.lit(False)).alias("base"), _features(kind, x).alias("f"))

    def spans(g: int, kind: int, base: bool) -> Column:
        return F.transform(F.filter(f"x{g}", lambda x: F.char_length(x["d"]) >= least[kind]), lambda x: span(kind, base, x))

    return out.select("row_id", "doc_id", F.concat(*(spans(g, k, base) for g, (k, _, base) in enumerate(generators))).alias("spans"))


@dataclass
class Tree:
    """A tree whose nodes of a level share one question: (feature, threshold) a level, and a leaf for each set of answers."""

    questions: list[tuple[int, int]]
    leaves: list[float]

    def literal(self) -> Column:
        """The tree as a constant, so that trees of all rounds run through one compiled plan."""
        asked = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in self.questions)).cast("array<struct<k:int,t:int>>")
        return F.struct(asked.alias("q"), F.array(*map(F.lit, self.leaves)).cast("array<double>").alias("l"))


def leaf_of(tree: Column, f: Column) -> Column:
    return F.aggregate(tree["q"], F.lit(0), lambda s, q: 2 * s + (F.get(f, q["k"]) > q["t"]).cast("int"))


def probability(trees: list[Tree], f: Column, start: float) -> Column:
    all_ = F.array(*(t.literal() for t in trees)).cast("array<struct<q:array<struct<k:int,t:int>>,l:array<double>>>")
    score = F.aggregate(all_, F.lit(float(start)), lambda s, t: s + F.get(t["l"], leaf_of(t, f)))
    return F.round(1 / (1 + F.exp(-score)), 6)


def boost(seen: DataFrame) -> tuple[list[Tree], float]:
    """Trees by second-order boosting of the log loss over seen (f, yes, no): different descriptions with their counts.

    A level's question is the one with the largest gain over the sums of gradients per leaf, feature and value: a table of
    bounded size (features x values x leaves), however many candidates there are. Sums are rounded, so that the order
    of additions doesn't choose the question; ties go to the first feature and the smallest threshold.
    """
    yes, no = seen.agg(F.sum("yes"), F.sum("no")).first()
    if not yes or not no:
        return [], 0.0 if not yes and not no else (9.0 if yes else -9.0)
    start, trees = round(math.log(yes / no), 6), []
    for _ in range(TREES):
        p = probability(trees, F.col("f"), start)
        here = seen.select("f", (F.col("yes") - (F.col("yes") + F.col("no")) * p).alias("g"), ((F.col("yes") + F.col("no")) * p * (1 - p)).alias("h"))
        tree = Tree([], [0.0])
        for _ in range(DEPTH):
            sums = here.select(leaf_of(tree.literal(), F.col("f")).alias("leaf"), "g", "h", F.posexplode("f").alias("k", "v")).groupBy("leaf", "k", "v").agg(F.round(F.sum("g"), 6).alias("g"), F.round(F.sum("h"), 6).alias("h")).collect()
            tree.questions.append(_question(sums))
        tree.leaves = _leaves(sums, tree.questions[-1])
        trees.append(tree)
    return trees, start


def _question(sums: list) -> tuple[int, int]:
    """(feature, threshold) with the largest gain, from rows of leaf, k, v, g, h."""
    values = sorted({(r["k"], r["v"]) for r in sums})
    leaf_total: dict = {}
    for r in sums:
        if r["k"] == 0:
            g, h = leaf_total.get(r["leaf"], (0.0, 0.0))
            leaf_total[r["leaf"]] = (g + r["g"], h + r["h"])
    at = {(r["k"], r["v"], r["leaf"]): (r["g"], r["h"]) for r in sums}
    best, chosen, below, last = -1.0, (0, 0), {}, None
    for k, v in values:
        if k != last:
            below, last = dict.fromkeys(leaf_total, (0.0, 0.0)), k
        gain = 0.0
        for leaf, (g, h) in leaf_total.items():
            a, b = at.get((k, v, leaf), (0.0, 0.0))
            below[leaf] = (below[leaf][0] + a, below[leaf][1] + b)
            gl, hl = below[leaf]
            gain += gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (max(h - hl, 0.0) + RIDGE)
        if round(gain, 4) > best:
            best, chosen = round(gain, 4), (k, v)
    return chosen


def _leaves(sums: list, last: tuple[int, int]) -> list[float]:
    """A leaf's step from the last level's sums; a leaf that no candidate reaches gets the least of the others."""
    total: dict = {}
    for r in sums:
        if r["k"] == last[0]:
            leaf = 2 * r["leaf"] + (r["v"] > last[1])
            g, h = total.get(leaf, (0.0, 0.0))
            total[leaf] = (g + r["g"], h + r["h"])
    steps = {leaf: round(STEP * g / (h + RIDGE), 6) for leaf, (g, h) in total.items()}
    return [steps.get(leaf, min(steps.values())) for leaf in range(1 << DEPTH)]


def thresholds(held: DataFrame, trees: list[Tree], start: float) -> dict[int, float]:
    """For each kind the least probability from which on up held-out candidates are base spans, at least PRECISION of them.

    That must hold at every probability that occurs and for all above it together, with one added to those that aren't: a
    kind that is hardly seen gets no threshold, and adds nothing.
    """
    scored = held.select(F.get("f", F.lit(0)).alias("kind"), probability(trees, F.col("f"), start).alias("p"), "yes", "no").groupBy("kind", "p").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    above = Window.partitionBy("kind").orderBy(F.desc("p"))
    share = F.least(F.sum("yes").over(above) / (F.sum("yes").over(above) + F.sum("no").over(above) + 1), F.min(F.col("yes") / (F.col("yes") + F.col("no"))).over(above))
    return {r["kind"]: r["p"] for r in scored.withColumn("share", share).where(F.col("share") >= PRECISION).groupBy("kind").agg(F.min("p").alias("p")).collect()}


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data per row of df: the id, base and added, arrays of (start, kind, end) in order.

    Base spans are the leftmost matches of each kind's pattern that pass its test. Candidates are these and the spans of
    further generators, which may overlap. Boosted trees learn from all documents but the held-out quarter to tell base
    spans from candidates that overlap none, by format and context; on the held-out quarter each kind gets the least
    probability above which PRECISION of the candidates are base spans: see thresholds(). A candidate above it is added unless it overlaps
    a base span; of added ones that overlap, the most probable stays (then the longest, the first).

    A null text is empty; rows without spans have empty arrays; repeated rows and ids are rows of their own; ids may be null
    (null ids learn). An empty table gives an empty result; other columns are not read. Only one text's candidates meet
    in one task.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = staged(candidates(df, id_col, text_col), "pii-candidates")
    each = rows.where(F.size("spans") > 0).select("row_id", "doc_id", F.explode("spans").alias("x")).select("row_id", "doc_id", "x.*")
    each = each.groupBy("row_id", "kind", "start", "end").agg(F.max(F.struct("base", "f")).alias("x"), F.any_value("doc_id").alias("doc_id")).select("row_id", "doc_id", "kind", "start", "end", "x.base", "x.f")
    order = Window.partitionBy("row_id").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after) < F.col("end"), F.lit(False))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    found = staged(each.withColumn("overlaps", near).withColumn("held", held), "pii-found")

    counted = found.where("base or not overlaps").groupBy("f", "held").agg(F.sum(F.col("base").cast("long")).alias("yes"), F.sum((~F.col("base")).cast("long")).alias("no"))
    counted = staged(counted, "pii-descriptions")
    trees, start = boost(counted.where("not held"))
    least = thresholds(counted.where("held"), trees, start) if trees else {}

    chosen = F.lit(False)
    for k, p in least.items():
        chosen = chosen | ((F.col("kind") == k) & (F.col("p") >= p))
    free = found.where("not base and not overlaps").withColumn("p", probability(trees, F.col("f"), start)).where(chosen)
    island = F.coalesce((F.max("end").over(before) <= F.col("start")).cast("int"), F.lit(1))
    free = free.withColumn("new", island).withColumn("island", F.sum("new").over(order))
    best = free.groupBy("row_id", "island").agg(F.max_by(F.struct("start", "kind", "end"), F.struct("p", F.col("end") - F.col("start"), -F.col("start"), -F.col("kind"))).alias("x"))
    added = best.groupBy("row_id").agg(F.array_sort(F.collect_list("x")).alias("added"))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = F.array_sort(F.transform(F.filter("spans", lambda x: x["base"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    out = rows.select("row_id", "doc_id", base.alias("base")).join(added, "row_id", "left")
    return out.select(F.col("doc_id").cast(kind).alias(id_col), "base", F.coalesce("added", empty).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    name = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, n_<kind> of the base spans, base_sha256 of their list, and spans, the list of base and added ones; n_added."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        id_col, *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(text: Column, spans: Column) -> Column:
    """A text with its spans, in order of start, replaced by [KIND]; where spans overlap the first one's mark stands for both."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), x["kind"])), F.lit("]"))
        put = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), mark)
        return F.when(x["start"] >= s["at"], F.struct(put.alias("out"), x["end"].alias("at"))).otherwise(F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at")))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
