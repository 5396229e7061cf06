"""Files in and out, and the stream, on small folders."""

import pytest

from termloom.operators import dictionary as D
from termloom.operators.matching import dictionary_hits, find_mentions, mention_rows, with_blocked
from termloom.operators.segments import inside_segments, segments
from termloom.operators.windows import candidate_windows
from termloom.sources import files, sinks
from termloom.streaming.tagging import document_stream, stream_scores, tag_stream

LINES = [
    "PMID:12|DOI:1\ta\tj\t2020\tTIMP1 binds PLK1. \tATM-kinase was seen.",
    "",
    "X9\ta\tj\t\tt\tx",
    "PMID:0\ta\tj\t\tt\tx",
    "PMID:12\ta\tj\t\tagain\tx",
    "PMID:13\ta\tj\t2020\t",
    "PMID:13\ta\tj\t2020\tlate\tx",
    "DOI:10.1021/x\ta\tj\t2020\tten\tx\ty",
]


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_documents(spark, tmp_path):
    rows = files.read_documents(spark, put(tmp_path / "c.tsv", *LINES)).collect()
    assert {r.doc_id: r.text for r in rows} == {12: "TIMP1 binds PLK1. \tATM-kinase was seen.", 10: "ten\tx\ty"}
    folder = tmp_path / "texts"
    folder.mkdir()
    put(folder / "b.txt", "two", "lines")
    put(folder / "a.txt", "one")
    (folder / "c.txt").write_text("")
    put(folder / "d.tsv", "no")
    assert [(r.doc_id, r.name, r.text) for r in files.read_directory(spark, str(folder)).orderBy("doc_id").collect()] == [(1, "a.txt", "one\n"), (2, "b.txt", "two\nlines\n")]


def test_tables(spark, tmp_path):
    entities = files.read_entities(spark, put(tmp_path / "e", "1\t9606\tA\tmore", "2\tx\tB", "short\t1", "", "1\t-1\tC"))
    assert [(r.serial, r.type, r.identifier) for r in entities.orderBy("order").collect()] == [(1, 9606, "A"), (2, 0, "B"), (1, -1, "C")]
    assert {(r.serial, r.type) for r in D.entity_types(entities, "order").collect()} == {(1, -1), (2, 0)}
    stops = D.stop_list(files.read_stop_list(spark, put(tmp_path / "s", "the\tt", "the\tf", "of\t1", "or\tno")), "order")
    assert {(r.name, r.blocked) for r in stops.collect()} == {("the", False), ("of", True), ("or", False)}
    own = D.stop_list(files.read_local_stop_list(spark, put(tmp_path / "l", "the\t5\ty")), "order", local=True)
    assert [(r.name, r.doc_id, r.blocked) for r in own.collect()] == [("the", "5", True)]
    assert files.read_types(spark, put(tmp_path / "t", "9606", "-1x")).count() == 2
    assert files.read_groups(spark, put(tmp_path / "g", "1\t2", "1\t2")).count() == 2
    assert files.read_type_pairs(spark, put(tmp_path / "p", "1\t2")).collect()[0].type2 == 2
    sinks.append_change(spark, str(tmp_path / "log"), "BlockName", "x", "7")
    sinks.append_change(spark, str(tmp_path / "log"), "AllowName", "y", "7")
    assert {(r.action, r.name, r.doc_id) for r in files.read_change_log(spark, str(tmp_path / "log")).collect()} == {("BlockName", "x", "7"), ("AllowName", "y", "7")}


def dictionary(spark):
    names = spark.createDataFrame([(101, "TIMP-1"), (102, "PLK1"), (103, "ATM kinase")], "serial bigint, name string")
    return D.dictionary(D.names_of_type(names, 9606))


def test_outputs_and_stream(spark, tmp_path):
    known = dictionary(spark)

    def tag(documents):
        found = find_mentions(with_blocked(dictionary_hits(candidate_windows(documents, known), known)))
        return inside_segments(mention_rows(found), segments(documents))

    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox / "1.tsv", *LINES)
    paths = {k: str(tmp_path / k) for k in ("mentions", "sums", "segments", "check")}
    for name in ("1.tsv", "2.tsv"):
        put(inbox / name, *LINES)
        documents = document_stream(spark, str(inbox))
        tag_stream(documents, tag, paths["mentions"], paths["check"], paths["sums"], segments, paths["segments"]).awaitTermination()
    rows = spark.read.parquet(paths["mentions"])
    assert sorted((r.doc_id, r.sentence, r.text) for r in rows.collect()) == [(12, 1, "ATM-kinase"), (12, 1, "PLK1"), (12, 1, "TIMP1")]
    assert spark.read.parquet(paths["segments"]).count() == 5
    types = spark.createDataFrame([(s, 9606) for s in (101, 102, 103)], "serial bigint, type int")
    scores = stream_scores(spark, paths["sums"], types)
    assert round(scores.where("serial1 = 101 AND serial2 = 102").collect()[0].score, 6) == 1.963143

    sinks.write_all(rows, lambda r: sinks.write_mentions(r, str(tmp_path / "m.tsv")), lambda r: sinks.write_segments(segments(files.read_documents(spark, str(inbox / "1.tsv"))), str(tmp_path / "s.tsv")))
    assert "12\t1\t1\t0\t4\tTIMP1\t9606\t101" in {r.value for r in spark.read.text(str(tmp_path / "m.tsv")).collect()}
    assert "12\t1\t1\t0\t17" in {r.value for r in spark.read.text(str(tmp_path / "s.tsv")).collect()}
    sinks.write_pairs(scores, str(tmp_path / "p.tsv"))
    assert "101\t102\t1.963143\t0.943311\t5.200000\t4.200000\t4.200000\t3.200000" in {r.value for r in spark.read.text(str(tmp_path / "p.tsv")).collect()}


def test_programs_over_folders(spark, tmp_path):
    from termloom.plans.programs import tag_folder

    texts = tmp_path / "texts"
    texts.mkdir()
    put(texts / "a.txt", "Deep sea mud and alpine lake.")
    names = put(tmp_path / "names", "11\tdeep sea", "12\talpine lake", "13\tmud")
    groups = put(tmp_path / "groups", "11\t90", "13\t91")
    stops = put(tmp_path / "stops", "mud\tt")
    rows = tag_folder(spark, str(texts), names, -27, groups, stops).collect()
    assert sorted((r.name, r.text, r.type, r.serial) for r in rows) == [("a.txt", "Deep sea", -27, 11), ("a.txt", "Deep sea", -27, 90), ("a.txt", "alpine lake", -27, 12)]
    sinks.write_directory_mentions(tag_folder(spark, str(texts), names, -27), str(tmp_path / "out"), environments=True)
    assert "a.txt\t0\t7\tDeep sea\tENVO:00000011" in {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}


def test_corpus_of_files(spark, tmp_path):
    from termloom.plans.programs import Corpus, Options, tag_corpus, write_tagged

    corpus = Corpus(
        put(tmp_path / "c.tsv", *LINES), put(tmp_path / "e", "101\t9606\tA", "102\t9606\tB", "103\t9606\tC"), put(tmp_path / "n", "101\tTIMP-1", "102\tPLK1", "103\tATM kinase"),
        put(tmp_path / "t", "9606"), put(tmp_path / "s", "the\tt"), put(tmp_path / "l", "PLK1\t12\tt"), type_pairs=put(tmp_path / "p", "9606\t9606"),
    )
    tagged = tag_corpus(spark, corpus, Options(sentence_weight=0.0))
    out = [str(tmp_path / f"out_{k}") for k in "mps"]
    write_tagged(tagged, *out)
    assert tagged.progress.get["documents"] == 2
    lines = [sorted(r.value for r in spark.read.text(o).collect()) for o in out]
    assert lines[0] == ["12\t1\t1\t0\t4\tTIMP1\t9606\t101", "12\t2\t1\t19\t28\tATM-kinase\t9606\t103"]
    assert [x.split("\t")[:2] + x.split("\t")[-1:] for x in lines[1]] == [["101", "103", "1.000000"]] and len(lines[2]) == 5


def test_settings(spark, tmp_path):
    from pyspark.sql import functions as F

    from termloom.sources.settings import head_script, read_settings, type_rule

    head = put(tmp_path / "head.js", "<script>x</script>")
    file = put(tmp_path / "s.ini", "[GLOBAL]", f"java_scripts = {head}", "names_file = n.tsv", "[STYLES]", "2 = color: red", "1 = color: blue", "9 = color: grey", "[TYPES]", "1 = x > 0 and x != 5", "2 = x in (-25, -26) or not x < 0")
    settings = read_settings(spark, file)
    assert settings.script == "<script>x</script>" and settings.files["names_file"] == "n.tsv" and [css for _, css in settings.styles] == ["color: blue", "color: red", "color: grey"]
    df = spark.createDataFrame([(t,) for t in (7, 5, -26, -1)], "t int")
    got = df.select(*(F.lit(True) if rule is None else rule(F.col("t")) for rule, _ in settings.styles)).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, True), (False, True, True), (False, False, True)]
    assert head_script(spark, "https://x.example/a.js") == '<script src="https://x.example/a.js" type="text/javascript"></script>\n'
    for bad in ("__import__('os')", "x.y", "x ** 2 > 1", "y > 1"):
        with pytest.raises(ValueError):
            type_rule(bad)


def test_staged_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from termloom.sources.staging import checkpointed, shared_folder

    assert checkpointed(spark.range(5).where("id > 1")).count() == 3
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        shared_folder(cluster)
