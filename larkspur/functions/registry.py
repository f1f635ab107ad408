"""Known names and ids, as a table of any size, replaced in texts: words of texts meet the table in joins.

The result is that of one regular expression `\\b(form|form|...)\\b` in any case with the longest form first, which a
table of names is too large for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .arrays import sums_before

WORD = r"(?U)\w+"
#: Forms are broadcast up to so many rows and bytes; a larger table meets the words in a shuffled join.
BROADCAST_FORMS, BROADCAST_BYTES = 1_000_000, 64 << 20


def registry_forms(names: DataFrame, name_col: str = "name") -> DataFrame:
    """All forms of names and ids, in lower case: core, n_words, lead, form.

    A name of several parts that all begin with a letter also occurs as "Last, First", "Last First", "F. Last", "F Last".
    core is the form from its first to its last word character, n_words its number of words, lead what comes before it.
    Blank and null names, and forms without a word character, give none; a form that several names have is one row.
    """
    parts = F.filter(F.split("name", r"(?U)\s+"), lambda p: p != "")
    given, last = F.array_join(F.slice("parts", 1, F.size("parts") - 1), " "), F.element_at("parts", -1)
    initial = F.left(given, F.lit(1))
    turned = F.array(F.concat(last, F.lit(", "), given), F.concat_ws(" ", last, given), F.concat(initial, F.lit(". "), last), F.concat_ws(" ", initial, last))
    several = (F.size("parts") >= 2) & F.forall("parts", lambda p: p.rlike(r"^\p{L}"))
    named = names.select(F.regexp_replace(F.col(name_col), r"(?U)^\s+|\s+$", "").alias("name")).where("name <> ''").withColumn("parts", parts)
    each = named.select(F.explode(F.when(several, F.concat(F.array("name"), turned)).otherwise(F.array("name"))).alias("form")).select(F.lower("form").alias("form")).distinct()
    core = F.regexp_extract("form", r"(?Us)^\W*(\w(?:.*\w)?)", 1)
    return each.withColumn("core", core).where("core <> ''").select("core", F.regexp_count("core", F.lit(WORD)).alias("n_words"), F.regexp_extract("form", r"(?U)^(\W*)", 1).alias("lead"), "form")


def _word(c: Column) -> Column:
    return c.rlike(r"(?U)^\w$")


def registry_spans(df: DataFrame, forms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and spans: array of (start, end) of the forms in each text, leftmost first and longest first, without overlaps.

    Every run of as many words as some form has is looked up by its text, so what is joined is words with forms, not texts
    with names; only hits are gathered, per text. Lookups are broadcast when the counted forms are small.
    """
    forms = checkpointed(forms)
    n, size, lengths = forms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("core") + F.octet_length("form")), F.lit(0)), F.collect_set("n_words")).first()
    lookup = forms.groupBy("core").agg(F.collect_set(F.struct("lead", "form")).alias("forms"))
    lookup = F.broadcast(lookup) if n <= BROADCAST_FORMS and size <= BROADCAST_BYTES else lookup
    low = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").select("id", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    gaps = low.where(F.size("w") > 0).withColumn("g", F.split("t", WORD, -1))
    placed = gaps.withColumn("n", F.zip_with("w", F.slice("g", 1, F.size("w")), lambda w, g: F.char_length(w) + F.char_length(g))).withColumn("at", sums_before(F.col("n")))

    def runs(k: int) -> Column:
        def run(i: Column) -> Column:
            words, between = F.slice("w", i, k), F.slice("g", i + 1, k)
            core = F.array_join(F.zip_with(words, between, lambda w, g: F.concat(w, g)), "") if k > 1 else F.element_at("w", i)
            core = F.left(core, F.char_length(core) - F.char_length(F.element_at(between, -1))) if k > 1 else core
            start = F.get("at", i - 1) + F.char_length(F.get("g", i - 1))
            return F.struct(F.lower(core).alias("core"), start.alias("start"), F.char_length(core).alias("size"))

        return F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), run)

    no_runs = F.array().cast("array<struct<core:string,start:int,size:int>>")
    all_runs = F.concat(no_runs, *(F.when(F.size("w") >= k, runs(k)).otherwise(no_runs) for k in sorted(lengths)))
    met = placed.select("id", F.explode(all_runs).alias("r")).select("id", "r.*").join(lookup, "core")
    spans = met.select("id", F.explode("forms").alias("f"), "start").select("id", (F.col("start") - F.char_length("f.lead")).alias("start"), F.char_length("f.form").alias("size"), "f.form")
    found = spans.where("start >= 0").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("size")).alias("less"), "form"))).alias("found"))
    text = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def stands(x: Column) -> Column:
        """Whether the form stands there, marks around its words included, with a word's edge at both ends."""
        size, edge = -x["less"], lambda p: _word(F.substring("t", p, F.lit(1)))
        return (F.lower(F.substring("t", x["start"] + 1, size)) == x["form"]) & (((x["start"] > 0) & edge(x["start"])) != edge(x["start"] + 1)) & (edge(x["start"] + size) != edge(x["start"] + size + 1))

    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("kept"))

    def keep(s: Column, x: Column) -> Column:
        end = x["start"] - x["less"]
        return F.when(x["start"] >= s["end"], F.struct(end.alias("end"), F.concat(s["kept"], F.array(F.struct(x["start"].alias("start"), end.alias("end")))).alias("kept"))).otherwise(s)

    return found.join(text, "id").select("id", F.aggregate(F.filter("found", stands), start, keep, lambda s: s["kept"]).alias("spans"))


def mark_registry(df: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[NAME_OR_ID]", count_col: str | None = None, name_col: str = "name") -> DataFrame:
    """df with every known name or id in its texts replaced by the mark; count_col, if given, grows by their number.

    names is a table; each name stands for all its forms (registry_forms()), as whole words in any case. id_col must tell
    rows apart; rows with a null id, null texts and texts without a name stay as they are. Other columns stay.
    """
    spans = "registry_spans_" + "_" * sum(c.lower().startswith("registry_spans_") for c in df.columns)
    found = registry_spans(df, registry_forms(names, name_col), id_col, text_col).select(F.col("id").alias(f"{spans}id"), F.col("spans").alias(spans))
    both = df.join(found, F.col(id_col) == F.col(f"{spans}id"), "left").drop(f"{spans}id")
    text, begin = F.col(text_col), F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    put = F.aggregate(spans, begin, lambda s, x: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out"), x["end"].alias("at")), lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    out = both.withColumn(text_col, F.when(F.size(spans) > 0, put).otherwise(text))
    if count_col:
        n = F.greatest(F.size(spans), F.lit(0))
        out = out.withColumn(count_col, F.coalesce(n, F.lit(0)) + (F.col(count_col) if count_col in df.columns else F.lit(0)))
    return out.drop(spans)
