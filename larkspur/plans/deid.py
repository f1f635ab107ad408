"""De-identification queries: over documents, and over case notes that are written from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import deidentify as d
from ..functions import text as t
from ..functions.registry import mark_registry
from .routing import read

GIVEN = ["Amara", "Bruno", "Chiara", "Devi", "Emeka", "Farah", "Goran", "Hana"]
FAMILY = ["Okafor", "Silva", "McDonald", "O'Neil", "Smith-Jones", "Perera", "Novak", "Survey", "Haddad"]
REGISTRY = ["Bruno Silva", "Hana Novak"]
ID_PATTERNS = [r"\bREC-\d{4}\b"]
#: Notes of a task where all rules run over them: a file of orders in one piece would be one task otherwise.
NOTES_A_TASK = 2_048


def case_notes(spark, sf, per_task=None):
    """One note per order (doc_id, kind, text) with identifiers of most kinds, from its keys, dates and prices.

    per_task deals the orders over tasks of about so many, before their notes are written.
    """
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    if per_task:
        o = o.repartition(max(1, -(-o.count() // per_task)), "o_orderkey")
    one = lambda words, key: F.element_at(F.array(*map(F.lit, words)), (F.pmod(key, F.lit(len(words))) + 1).cast("int"))
    given, family = one(GIVEN, F.col("o_custkey")), one(FAMILY, k)
    parts = [
        F.lit("Patient "), given, F.lit(" "), family, F.lit(", MRN "), (k + 1000000).cast("string"), F.lit(", born "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit(", seen "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" by Dr. "), family, F.lit(". Tel +44 7700 "), (F.pmod(k, F.lit(100000)) + 900000).cast("string"), F.lit(", mail "), F.lower(given), F.lit("."), F.col("o_custkey").cast("string"),
        F.lit("@mail.example.com. Card 4"), F.lpad(k.cast("string"), 15, "0"), F.lit(" for "), F.format_string("%.2f", "o_totalprice"), F.lit(". SSN "), F.lpad(F.pmod(k, F.lit(900)).cast("string"), 3, "1"), F.lit("-12-3456, host 10.0."), F.pmod(k, F.lit(256)).cast("string"),
        F.lit(".7, https://x.example/"), k.cast("string"), F.lit(" aged "), (F.pmod(k, F.lit(30)) + 80).cast("string"), F.lit("; "), family, F.lit(", "), given, F.lit(" of "), F.pmod(k, F.lit(90)).cast("string"), F.lit(" Old Mill Lane, Kandy, ref REC-"), F.lpad(F.pmod(k, F.lit(9999)).cast("string"), 4, "0"), F.lit("."),
    ]
    return o.select(k.alias("doc_id"), F.col("o_orderpriority").alias("kind"), F.concat(*parts).alias("text"))


def _pick(words, key):
    return "(CASE " + " ".join(f"WHEN {key} % {len(words)} = {i} THEN '" + w.replace("'", "''") + "'" for i, w in enumerate(words)) + " END)"


_G, _F = _pick(GIVEN, "o_custkey"), _pick(FAMILY, "o_orderkey")
NOTES = f"""notes AS (SELECT o_orderkey AS doc_id, o_orderpriority AS kind, 'Patient ' || {_G} || ' ' || {_F} || ', MRN ' || (o_orderkey + 1000000) || ', born ' || strftime(o_orderdate, '%d/%m/%Y') || ', seen ' || strftime(o_orderdate, '%-d %B %Y')
 || ' by Dr. ' || {_F} || '. Tel +44 7700 ' || (o_orderkey % 100000 + 900000) || ', mail ' || lower({_G}) || '.' || o_custkey || '@mail.example.com. Card 4' || lpad(o_orderkey::VARCHAR, 15, '0') || ' for ' || printf('%.2f', o_totalprice)
 || '. SSN ' || lpad((o_orderkey % 900)::VARCHAR, 3, '1') || '-12-3456, host 10.0.' || (o_orderkey % 256) || '.7, https://x.example/' || o_orderkey || ' aged ' || (o_orderkey % 30 + 80) || '; ' || {_F} || ', ' || {_G} || ' of ' || (o_orderkey % 90) || ' Old Mill Lane, Kandy, ref REC-' || lpad((o_orderkey % 9999)::VARCHAR, 4, '0') || '.' AS text FROM orders)"""


def re2(pattern: str) -> str:
    """A rule's pattern for SQL: word characters of all scripts spelled out, quotes doubled."""
    return pattern.replace(r"\w", r"\p{L}\p{N}_").replace("'", "''")


_LUHN = "list_sum([CASE WHEN y > 9 THEN y - 9 ELSE y END FOR y IN [x::INT * (1 + (i - 1) % 2) FOR x, i IN list_reverse(string_split(regexp_replace({n}, '[^0-9]', '', 'g'), ''))]]) % 10 = 0"


def rules_sql(rules, source: str, keep: str = "doc_id, kind") -> str:
    """SQL that applies rules to a table with a column text, and counts what each label's rules replace."""
    last, labels = f"SELECT {keep}, text AS t FROM {source}", []
    for rule in rules:
        name = f"n_{rule.label.lower()}"
        before, behind = (r"\1", "(^|[^\\p{L}\\p{N}_-])") if rule.pattern == d.PHONE else ("", "")
        p = behind + re2(rule.pattern.replace(r"(?<![\w-])", ""))
        if rule.test is None:
            new, n = f"regexp_replace(t, '{p}', '{before}{rule.mark}', 'g')", f"len(regexp_extract_all(t, '{p}'))"
        else:
            ok = _LUHN if rule.test is d.luhn else "string_split({n}, ' ')[1] NOT IN (" + ", ".join(f"'{w}'" for w in d.NOT_NAMES) + ")"
            g = [f"regexp_extract_all(t, '{p}', {k})" for k in range(4)]
            each = f"[CASE WHEN {ok.format(n='x[3]')} THEN x[2] || '{rule.mark}' || x[4] ELSE x[1] END FOR x IN list_zip({', '.join(g)})]"
            new = f"array_to_string([x[1] || coalesce(x[2], '') FOR x IN list_zip(regexp_split_to_array(t, '{p}'), {each})], '')"
            n = f"len([x FOR x IN {g[2]} IF {ok.format(n='x')}])"
        labels_now = [x for x in labels if x != name]
        counts = ", ".join([*labels_now, f"{name} + {n} AS {name}" if name in labels else f"{n} AS {name}"])
        last = f"SELECT {keep}, {counts}, {new} AS t FROM ({last})"
        labels = [*labels_now, name]
    return f"SELECT {keep}, {', '.join(labels)}, t AS text FROM ({last})"


def _sums(rules):
    return sorted({f"n_{r.label.lower()}" for r in rules})


def d1_redact_pii(spark, sf):
    """Texts as they are embedded and described: addresses, numbers and phones replaced."""
    return read(spark, sf, "documents").select("doc_id", F.md5(d.redact_pii(F.col("text"))).alias("digest"))


D1 = f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{re2(d.EMAIL)}', '[REDACTED_EMAIL]', 'g'), '{re2(d.SSN)}', '[REDACTED_ID]', 'g'), '{re2(d.PHONE_WIDE)}', '[REDACTED_PHONE]', 'g')) AS digest FROM documents"


def _counted(df, rules, key):
    names = _sums(rules)
    out = d.apply_rules(df, rules, counted=True)
    return out.groupBy(key).agg(*(F.sum(n).alias(n) for n in names), F.sum(F.length("text")).alias("chars_left"))


def _counted_sql(rules, table, key):
    return f"SELECT {key}, {', '.join(f'sum({n})::BIGINT AS {n}' for n in _sums(rules))}, sum(length(text))::BIGINT AS chars_left FROM ({rules_sql(rules, table, key)}) GROUP BY {key}"


def d2_redact(spark, sf):
    """How often each identifier occurs, by source, and how much text is left: all rules of the basic level."""
    return _counted(read(spark, sf, "documents").select("source", "text"), d.basic_rules(), "source")


def d3_case_notes(spark, sf):
    """The basic level on case notes with a registry and an institution's own pattern: the text and the marks in it."""
    rules = d.basic_rules(REGISTRY, ID_PATTERNS)
    out = d.apply_rules(case_notes(spark, sf), rules, counted=True)
    return out.select("doc_id", F.md5("text").alias("digest"), sum((F.col(n) for n in _sums(rules)), F.lit(0)).alias("marks"))


def _person(key):
    """A given name and a family name of letters that stand for the key's digits, one for each customer."""
    given = F.element_at(F.array(*map(F.lit, GIVEN)), (F.pmod(key, F.lit(len(GIVEN))) + 1).cast("int"))
    return given, F.concat(F.lit("K"), F.translate(key.cast("string"), "0123456789", "abcdefghij"))


def d11_registry(spark, sf):
    """Visit notes of all orders with their customers' names in several forms, against a registry of every second customer."""
    key = F.col("o_custkey")
    given, family = _person(key)
    parts = [F.lit("Seen: "), given, F.lit(" "), family, F.lit("; "), F.upper(F.concat(family, F.lit(", "), given)), F.lit(" ("), F.left(given, F.lit(1)), F.lit(". "), family, F.lit("/"), F.left(given, F.lit(1)), F.lit(" "), family, F.lit(") not "), given, F.lit("-"), family, F.lit("x "), family, F.lit(" "), given, F.lit(".")]
    notes = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(*parts).alias("text"))
    one, two = _person(F.col("c_custkey"))
    names = read(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(one, F.lit(" "), two).alias("name"))
    return mark_registry(notes, names, count_col="marks").select("doc_id", F.md5("text").alias("digest"), "marks")


_GIVEN_SQL, _FAMILY_SQL = _pick(GIVEN, "o_custkey"), "('K' || translate(o_custkey::VARCHAR, '0123456789', 'abcdefghij'))"
D11 = f"""WITH n AS (SELECT o_orderkey AS doc_id, {_GIVEN_SQL} AS g, {_FAMILY_SQL} AS f, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS known FROM orders)
SELECT doc_id, md5(CASE WHEN known THEN 'Seen: [NAME_OR_ID]; [NAME_OR_ID] ([NAME_OR_ID]/[NAME_OR_ID]) not ' || g || '-' || f || 'x [NAME_OR_ID].'
  ELSE 'Seen: ' || g || ' ' || f || '; ' || upper(f || ', ' || g) || ' (' || g[1] || '. ' || f || '/' || g[1] || ' ' || f || ') not ' || g || '-' || f || 'x ' || f || ' ' || g || '.' END) AS digest, CASE WHEN known THEN 5 ELSE 0 END AS marks FROM n"""


def d14_label_counts(spark, sf):
    """Replacements of each kind in the case notes, by order priority."""
    return _counted(case_notes(spark, sf).select("kind", "text"), d.basic_rules(REGISTRY, ID_PATTERNS), "kind")


_NOTE_RULES = d.basic_rules(REGISTRY, ID_PATTERNS)
D3 = f"WITH {NOTES} SELECT doc_id, md5(text) AS digest, {' + '.join(_sums(_NOTE_RULES))} AS marks FROM ({rules_sql(_NOTE_RULES, 'notes')})"
D14 = f"WITH {NOTES} {_counted_sql(_NOTE_RULES, 'notes', 'kind')}"


def d13_safe_harbor(spark, sf):
    """The strict level on case notes, with the words that documents write in lower case as the dictionary."""
    words = t.common_words(read(spark, sf, "documents")).select("word")
    out = d.deidentify(case_notes(spark, sf, NOTES_A_TASK), level="safe_harbor", registry=REGISTRY, id_patterns=ID_PATTERNS, common=words, counted=True)
    names = [f"n_{x.lower()}" for x in d.LABELS]
    return out.groupBy("kind").agg(*(F.sum(n).alias(n) for n in names), F.sum(F.length("text")).alias("chars_left"))


def d15_placeholders(spark, sf):
    """Texts without identifiers and without their marks."""
    out = d.apply_rules(read(spark, sf, "documents").select("doc_id", "text"), d.basic_rules())
    return out.select("doc_id", F.md5(d.strip_placeholders(F.col("text"))).alias("digest"))


D15 = f"SELECT doc_id, md5(regexp_replace(text, '{d.PLACEHOLDERS}', ' ', 'g')) AS digest FROM ({rules_sql(d.basic_rules(), 'documents', 'doc_id')})"


def a22_redaction_density(spark, sf):
    """Marks per 1,000 words and altered texts by language; recall of the case notes' card numbers is a22_redaction_recall."""
    rules = d.basic_rules()
    df = read(spark, sf, "documents").select("lang", "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w"))
    out = d.apply_rules(df, rules, counted=True).withColumn("n", sum((F.col(n) for n in _sums(rules)), F.lit(0)))
    return out.groupBy("lang").agg(F.round(F.sum("n") * 1000 / F.sum("w"), 6).alias("per_1000"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("altered"))


A22 = f"""WITH d AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents), r AS ({rules_sql(d.basic_rules(), 'd', 'lang, w')})
SELECT lang, round(sum({' + '.join(_sums(d.basic_rules()))}) * 1000.0::DOUBLE / sum(w), 6) AS per_1000, sum(({' + '.join(_sums(d.basic_rules()))} > 0)::INT)::BIGINT AS altered FROM r GROUP BY lang"""


def a22_redaction_recall(spark, sf):
    """Share of the case notes' identifiers that the basic level removes, by kind of identifier."""
    k = F.col("doc_id")
    planted = {"mrn": (k + 1000000).cast("string"), "card": F.concat(F.lit("4"), F.lpad(k.cast("string"), 15, "0")), "ssn": F.concat(F.lpad(F.pmod(k, F.lit(900)).cast("string"), 3, "1"), F.lit("-12-3456")), "record": F.concat(F.lit("REC-"), F.lpad(F.pmod(k, F.lit(9999)).cast("string"), 4, "0"))}
    out = d.apply_rules(case_notes(spark, sf), d.basic_rules())
    each = out.select(F.explode(F.create_map(*(x for n, c in planted.items() for x in (F.lit(n), ~F.contains("text", c))))).alias("category", "gone"))
    return each.groupBy("category").agg(F.round(F.avg(F.col("gone").cast("int")), 6).alias("recall"), F.count("*").alias("n"))


A22_RECALL = f"""WITH {NOTES}, r AS ({rules_sql(d.basic_rules(), 'notes')}),
x AS (SELECT text, unnest([{{'c': 'mrn', 'v': (doc_id + 1000000)::VARCHAR}}, {{'c': 'card', 'v': '4' || lpad(doc_id::VARCHAR, 15, '0')}}, {{'c': 'ssn', 'v': lpad((doc_id % 900)::VARCHAR, 3, '1') || '-12-3456'}}, {{'c': 'record', 'v': 'REC-' || lpad((doc_id % 9999)::VARCHAR, 4, '0')}}], recursive := true) FROM r)
SELECT c AS category, round(avg((NOT contains(text, v))::INT), 6) AS recall, count(*) AS n FROM x GROUP BY c"""


def c14_embedded_texts(spark, sf):
    """Vectors of texts whose identifiers are replaced first: hashed features of the redacted texts, by bucket."""
    from ..functions.vectors import hashed_features

    df = read(spark, sf, "documents").select("doc_id", d.redact_pii(F.col("text")).alias("text"))
    return hashed_features(df, "doc_id", "text").groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


C14 = f"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{re2(d.EMAIL)}', '[REDACTED_EMAIL]', 'g'), '{re2(d.SSN)}', '[REDACTED_ID]', 'g'), '{re2(d.PHONE_WIDE)}', '[REDACTED_PHONE]', 'g') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM r), b AS (SELECT doc_id, (('0x' || substr(sha256('m:' || t), 1, 8))::BIGINT % 256)::INT AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT bucket, count(*) AS docs, sum(n)::BIGINT AS n FROM b GROUP BY bucket"""

QUERIES = {
    "d1_redact_pii": (d1_redact_pii, D1), "d2_redact": (d2_redact, _counted_sql(d.basic_rules(), "documents", "source")), "d3_case_notes": (d3_case_notes, D3), "d11_registry": (d11_registry, D11), "d13_safe_harbor": (d13_safe_harbor, None), "d14_label_counts": (d14_label_counts, D14),
    "d15_placeholders": (d15_placeholders, D15), "a22_redaction_density": (a22_redaction_density, A22), "a22_redaction_recall": (a22_redaction_recall, A22_RECALL), "c14_embedded_texts": (c14_embedded_texts, C14),
}
