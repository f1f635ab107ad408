import json

from larkspur.sources import readers as r


def test_corpus_queries_and_judgements(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in [{"_id": "1", "title": " A ", "text": " b "}, {"_id": "2", "title": "", "text": "c"}]))
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t1\t1\nq1\t2\t0\n")
    (tmp_path / "g.txt").write_text("q1 0 a 2.5\nq1  0  zzz 1\n")
    assert {x["doc_id"]: x["text"] for x in r.corpus_jsonl(spark, str(tmp_path / "c.jsonl")).collect()} == {"1": "A. b", "2": "c"}
    assert [tuple(x) for x in r.qrels_tsv(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "1", 1)]
    known = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert [tuple(x) for x in r.graded_qrels(spark, str(tmp_path / "g.txt"), known).collect()] == [("q1", "a", 2.5)]


def test_node_files_skip_a_broken_one(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"node_id": "a", "documents": ["x", {"text": "y", "collection": "clinical"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"node_id": "b", "collections": {"public": ["u", "v"]}}))
    (tmp_path / "c.json").write_text("{broken")
    got = sorted(map(tuple, r.node_specs(spark, str(tmp_path)).collect()))
    assert got == [("a", 0, "x", "public"), ("a", 1, "y", "clinical"), ("b", 0, "u", "public"), ("b", 1, "v", "public")]
    left = r.unregistered(r.node_specs(spark, str(tmp_path)), spark.createDataFrame([("a",)], "source_id string"))
    assert [tuple(x) for x in left.collect()] == [("b", 2)]


def test_embedded_dictionaries_and_nested_questions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("patient_uid,PMID,patient,similar_patients\nu1,9,\"text, more\",\"{'u2': 2, 'u3': 1}\"\nu4,8,t,{}\n")
    got = sorted(((x["patient_uid"], x["similar"], x["grade"]) for x in r.patients_csv(spark, str(tmp_path / "p.csv")).collect()), key=str)
    assert got == [("u1", "u2", 2), ("u1", "u3", 1), ("u4", None, None)]
    (tmp_path / "q.json").write_text(json.dumps({"s": {"1": {"question": "?", "options": {"A": "x"}, "answer": "A"}}}))
    assert [(x["subset"], x["qid"], x["answer"], x["options"]) for x in r.questions_json(spark, str(tmp_path / "q.json")).collect()] == [("s", "1", "A", {"A": "x"})]


def test_log_appends_and_audit(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(2):
        r.append_log(spark.createDataFrame([(f"q{k}", ["a", "b", "a", "c"], ["a"], float(k))], "query_id string, dispatched array<string>, genuine array<string>, timestamp double"), path)
    log = r.read_log(spark, path)
    assert log.count() == 2
    assert r.audit(log, "q1").collect()[0]["derived_decoys"] == ["b", "c"]


def test_newest_file_wins_union_and_cache(spark, tmp_path):
    import os

    for k, name in enumerate(("a", "b")):
        p = tmp_path / "r" / f"{name}.csv"
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"k,v\nx,{k}\n{name},{k}\n")
        os.utime(p, (1_000_000 + k * 100, 1_000_000 + k * 100))
    df = spark.read.csv(str(tmp_path / "r"), header=True)
    assert sorted(map(tuple, r.newest_file_wins(df, ["k"]).collect())) == [("a", "0"), ("b", "1"), ("x", "1")]
    both = r.union_results([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert both.columns == ["a", "b"] and both.count() == 2
    asked = spark.createDataFrame([("t",), ("t",), ("u",)], "text string")
    hit, miss = r.cached(asked, spark.createDataFrame([], "key string, vec array<double>"), "m")
    assert hit.count() == 0 and miss.count() == 2


def test_a_lookup_in_a_sorted_log_reads_few_rows(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("concat('q', lpad(id * 2, 6, '0')) AS query_id", "'t' AS topic_key", "array('a') AS genuine", "cast(array() AS array<string>) AS decoys", "array('b', 'a', 'b') AS dispatched", "cast(array() AS array<string>) AS coarse", "cast(null AS map<string,double>) AS stage_latency_ms", "cast(null AS map<string,double>) AS bytes_transferred", "cast(id AS double) AS timestamp", "'' AS extra")
    again = rows.where("query_id = 'q000100'").selectExpr("* EXCEPT (timestamp)", "-1.0D AS timestamp").select(rows.columns)
    path = str(tmp_path / "log")
    r.write_sorted_log(rows.unionByName(again), path, 8)

    def looked_up(q):
        df = r.audit_at(spark, path, q)
        found = df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return found, leaf.metrics().apply("numOutputRows").value()

    found, read = looked_up("q000100")
    assert found[0]["timestamp"] == -1.0 and found[0]["derived_decoys"] == ["b", "b"] and 0 < read <= 5_000
    assert looked_up("q000101") == ([], 0)
