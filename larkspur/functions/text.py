"""Text expressions: tokenising, topics, sessions, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .deidentify import redact_pii, strip_placeholders

# ---- Fixed values: word lists that must equal the published ones. ----

#: Words that never become topics.
TOPIC_STOPWORDS = """a about above after again against all also among an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have having here how however
i if in into is it its itself just may might more most much must no nor not now of off on once only or other our out over
own per same should so some such than that the their them then there these they this those through to too under until up
upon us use used using very was we were what when where which while who whom why will with within without would you your
abstract background conclusion conclusions data demonstrate demonstrated et found introduction methods new paper patients
result results showed shows significant significantly study studies suggest text therefore these thus via whether redacted
email phone id one two three four five six seven eight nine ten first second third""".split()

#: Words that lexical scores leave out.
LEXICAL_STOPWORDS = """a about above after again against all also am an and any are as at be because been before being below between
both but by can could did do does doing down during each few for from further had has have having he her here hers herself
him himself his how however i if in into is it its itself just me more most my myself no nor not now of off on once only or
other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will with
would you your yours yourself yourselves may might must shall upon within without via per among""".split()

# ---- End of fixed values. ----


def _list(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters of any script, less stop words."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(runs, lambda w: ~w.isin(LEXICAL_STOPWORDS))


def document_topics(docs: DataFrame, group: str, text_col: str = "text", most: int = 16) -> DataFrame:
    """The words that most documents of each group have: group, rank, term, df. Ties go to the earlier word."""
    if not 1 <= most <= 64:
        raise ValueError("most must be from 1 to 64")
    runs = F.regexp_extract_all(F.lower(strip_placeholders(redact_pii(F.coalesce(F.col(text_col), F.lit(""))))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    words = F.array_except(F.array_distinct(F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$"))), _list(TOPIC_STOPWORDS))
    df = docs.select(group, F.explode(words).alias("term")).groupBy(group, "term").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("df"), "term"))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)


def describe(topics: DataFrame, group: str) -> DataFrame:
    """One sentence per group from its topics in order."""
    each = topics.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return each.select(group, F.concat(F.lit("Collection topics: "), F.array_join(F.transform("t", lambda x: x["term"]), ", "), F.lit(".")).alias("description"))


def common_words(docs: DataFrame, text_col: str = "text", least: int = 3) -> DataFrame:
    """Words that occur in lower case at least so often: word, n."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1))
    words = F.filter(runs, lambda w: w.rlike("^[a-z][a-z']+$"))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def session_chunks(text: Column, chunks: int = 5) -> Column:
    """A text's sentences of three or more words in equal consecutive chunks; null with fewer sentences than chunks."""
    sentences = F.filter(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 3)
    n = F.size(sentences)
    cut = lambda k: F.floor(F.lit(float(k)) * n / chunks).cast("int")
    parts = F.array(*(F.array_join(F.slice(sentences, cut(k) + 1, cut(k + 1) - cut(k)), " ") for k in range(chunks)))
    return F.when(n >= chunks, parts)


def term_recovery(truth: Column, guess: Column) -> Column:
    """Jaccard of the lower-case words; an empty truth gives 0."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    t, g = words(truth), words(guess)
    return F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(t, g)) / F.size(F.array_union(t, g)))


def answer_letter(text: Column, options: list[str] | None = None) -> Column:
    """The letter (A to D, of the given options) that an answer begins with, or else the first that stands alone; or null."""
    known = options or ["A", "B", "C", "D"]
    stripped = F.btrim(text, F.lit(" \t\n\r"))
    first = F.regexp_extract(F.concat(stripped, F.lit(" ")), r"^\(?([A-D])\)?[.):\s]", 1)
    alone = F.filter(F.regexp_extract_all(stripped, F.lit(r"\b([A-D])\b"), F.lit(1)), lambda x: x.isin(known))
    return F.when(first.isin(known), first).otherwise(F.get(alone, F.lit(0)))


def choice_prompt(question: Column, options: Column) -> Column:
    """A question with its options (map of letter to text) by letter, and how to answer."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda o: F.concat(o["key"], F.lit(". "), o["value"])), "\n")
    return F.concat(question, F.lit("\n\nOptions:\n"), lines, F.lit("\n\nChoose the best option. Reply with the single option letter only."))


#: Fixed value: what an answer is asked with, around the question and its passages.
PROMPT = (
    "Answer the question using only the passages below. If the passages don't contain the answer, say so plainly rather than guessing.\n\nQuestion: ",
    "\n\nPassages:\n", "\n\nAnswer:", "(none returned)",
)


def passage_prompt(question: Column, passages: Column) -> Column:
    listed = numbered_passages(passages)
    return F.concat(F.lit(PROMPT[0]), question, F.lit(PROMPT[1]), F.when(listed == "", F.lit(PROMPT[3])).otherwise(listed), F.lit(PROMPT[2]))


def numbered_passages(passages: Column) -> Column:
    """Passages as a numbered list, in order."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")


def exposed(values: Column, text: Column) -> Column:
    """Share of values that a text holds, in any case."""
    return F.size(F.filter(values, lambda v: F.contains(F.lower(text), F.lower(v)))) / F.size(values)
