import json

import pytest

from feedlens.sources import adapters, exports, files, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_feedback_mixes_formats(spark, tmp_path):
    write(tmp_path / "a.csv", 'Subject ,DESCRIPTION,id\nUI,"two\nlines",7\nX,,8\n')
    write(tmp_path / "b.json", json.dumps({"tickets": [{"ticket_id": 1, "topic": "T", "message": "m"}, "skip"]}))
    write(tmp_path / "c.txt", "# comment\n\nfirst note with many words\nsecond\n")
    got = {(r["ticket_id"], r["topic"], r["message"]) for r in files.read_feedback(spark, str(tmp_path)).collect()}
    assert got == {("7", "UI", "two\nlines"), ("1", "T", "m"), ("1", "first note with many", "first note with many words"), ("2", "second", "second")}


def test_files_with_other_headers_are_read_apart(spark, tmp_path):
    write(tmp_path / "a.csv", "message,id\nm1,1\n")
    write(tmp_path / "b.csv", "id,text\n2,m2\n")
    got = {(r["ticket_id"], r["message"]) for r in files.read_feedback(spark, str(tmp_path)).collect()}
    assert got == {("1", "m1"), ("2", "m2")}


def test_bad_files(spark, tmp_path):
    empty = tmp_path / "x"
    empty.mkdir()
    write(empty / "e.csv", "")
    with pytest.raises(files.EmptyInput):
        files.read_feedback(spark, str(empty))
    with pytest.raises(files.UnsupportedFileType):
        files.detect_format("a/b.pdf")


@pytest.mark.parametrize("doc,want", [
    ([{"m": 1}, 5, {"m": 2}], ["1", "2"]),
    ({"note": "x", "records": [{"m": 3}]}, ["3"]),
    ({"a": {"m": 4}, "b": {"m": 5}, "c": 1}, ["4", "5"]),
    ({"m": 6}, ["6"]),
])
def test_json_record_extraction(spark, tmp_path, doc, want):
    path = write(tmp_path / "d.json", json.dumps(doc))
    rows = files.records_to_columns(files.read_json_records(spark, path), ["at"])
    assert [r["m"] for r in rows.orderBy("at").collect()] == want


def test_normalize_rules(spark):
    raw = spark.createDataFrame([("1", None, " hi "), (None, "b", "yo"), ("3", "c", "  ")], "ID string, Title string, Feedback string")
    got = sorted(tuple(r)[:4] for r in files.normalize(raw, order=["Feedback"]).collect())
    assert got == [("1", None, "General Feedback", "hi"), ("2", None, "b", "yo")]
    # no known header: the first text column is the message; ids and topics are derived
    raw = spark.createDataFrame([("b c d e f", 1), ("a", 2)], "whatever string, n int")
    got = [tuple(r)[:4] for r in files.normalize(raw, order=["n"]).orderBy("pos").collect()]
    assert got == [("1", None, "b c d e", "b c d e f"), ("2", None, "a", "a")]
    with pytest.raises(files.InvalidSchema):
        files.normalize(spark.createDataFrame([(1,)], "n int"))


def test_support_and_conversation_exports(spark, tmp_path):
    desk = tmp_path / "desk"
    desk.mkdir()
    write(desk / "p1.json", json.dumps({"tickets": [{"id": 1, "created_at": "2024-01-01", "subject": "s", "description": "d"}], "next_page": "x"}))
    write(desk / "p2.json", json.dumps({"tickets": [{"id": 2, "description": "e"}], "next_page": None}))
    got = {(r["ticket_id"], r["topic"], r["message"]) for r in exports.load_export(spark, "zendesk", str(desk)).collect()}
    assert got == {("1", "s", "d"), ("2", "", "e")}
    talks = write(tmp_path / "t.json", json.dumps({"conversations": [
        {"id": "a", "source": {"subject": "", "body": "b1"}, "title": "tt"}, {"id": "b", "source": {"subject": "ss", "body": "b2"}}]}))
    got = {(r["ticket_id"], r["topic"], r["message"]) for r in exports.load_export(spark, "intercom", talks).collect()}
    assert got == {("a", "tt", "b1"), ("b", "ss", "b2")}
    with pytest.raises(files.IngestError):
        exports.load_export(spark, "fax", talks)


def test_page_properties(spark, tmp_path):
    props = {
        "Title": {"type": "title", "title": [{"plain_text": "Dark "}, {"plain_text": "mode"}]},
        "Body": {"type": "rich_text", "rich_text": [{"plain_text": "please"}]},
        "Tags": {"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]},
        "State": {"type": "status", "status": {"name": "open"}}, "None": {"type": "select", "select": None},
        "When": {"type": "date", "date": {"start": "2024-05-01"}}, "N": {"type": "number", "number": 4.5},
        "Done": {"type": "checkbox", "checkbox": True}, "Odd": {"type": "formula", "formula": {"x": 1}},
    }
    path = write(tmp_path / "n.json", json.dumps({"results": [{"id": "pg", "created_time": "2024", "properties": props}]}))
    row = exports.page_properties(exports.read_pages(spark, path, "results")).first().asDict()
    want = {"Title": "Dark mode", "Body": "please", "Tags": "a, b", "State": "open", "None": None, "When": "2024-05-01", "N": "4.5",
            "Done": "true", "Odd": '{"x":1}', "_page_id": "pg", "_created_time": "2024"}
    assert {k: row[k] for k in want} == want
    ticket = exports.load_export(spark, "notion", path).first()
    assert (ticket["ticket_id"], ticket["topic"], ticket["message"]) == ("1", "Dark mode", "please")


def test_dataset_registry(spark, tmp_path):
    reviews = write(tmp_path / "r.csv", "reviewId,content,score,at\ng1,nice,5,2024-01-01\ng2,,1,\n")
    issues = write(tmp_path / "i.json", json.dumps([{"number": 9, "title": "t", "body": "b", "created_at": "2024-01-02T00:00:00Z", "labels": ["x"]}]))
    goods = write(tmp_path / "a.json", json.dumps([{"reviewerID": "R", "asin": "P", "summary": "s", "reviewText": "w", "reviewTime": "06 15, 2023"}]))
    config = {"datasets": [
        {"name": "apps", "format": "csv", "path": reviews, "adapter": "GooglePlayAdapter"},
        {"name": "issues", "format": "json", "path": issues, "adapter": "GitHubIssuesAdapter"},
        {"name": "goods", "format": "json", "path": goods, "adapter": "AmazonReviewsAdapter"},
    ]}
    got = {(r["dataset"], r["ticket_id"], r["topic"], r["message"]) for r in adapters.load_datasets(spark, config).collect()}
    assert got == {("apps", "g1", "App Review (Rating 5/5)", "nice"), ("issues", "GH-9", "t", "b"), ("goods", "R_P", "s", "w")}
    with pytest.raises(KeyError):
        adapters.load_dataset(spark, "nope", config)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "text")], "proposal_id string, prompt string")
    sinks.write_table(df, str(tmp_path / "t"), "json", partition_by=["proposal_id"])
    assert spark.read.json(str(tmp_path / "t")).count() == 1
    sinks.write_texts(df, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()["value"] == "text"


def test_positions_are_unique_over_formats_and_headers(spark, tmp_path):
    from feedlens.functions.text import embedding_text
    from feedlens.operators import dedup, encode
    from feedlens.plans import pipelines
    from pyspark.sql import functions as F

    (tmp_path / "a.csv").write_text("id,topic,message\n1,x,red apples fall\n2,x,green pears grow\n")
    (tmp_path / "b.csv").write_text("topic,message\ny,blue plums rot\ny,white grapes dry\n")
    (tmp_path / "c.json").write_text('[{"id": 7, "topic": "z", "message": "dogs bark"}, {"id": 8, "topic": "z", "message": "cats purr"}]')
    (tmp_path / "d.txt").write_text("birds: sing early\nfish: swim deep\n")
    tickets = files.read_feedback(spark, str(tmp_path))
    assert sorted(r["pos"] for r in tickets.collect()) == sorted({r["pos"] for r in tickets.collect()}) and tickets.count() == 8
    fitted = encode.fit_text_encoder(tickets, embedding_text(F.col("topic"), F.col("message")))
    rows = pipelines.encode_tickets(tickets, fitted)
    none = F.col("pos") < F.lit(0)  # no similar pairs: texts differ
    edges = lambda v, t: v.where(none).select(F.col("pos").alias("a"), F.col("pos").alias("b"))
    members = dedup.corpus_components(rows, edges).collect()
    assert len(members) == 8 and len({r["component"] for r in members}) == 8


def test_text_ids_count_per_file_over_small_splits(spark, tmp_path):
    for name, n in (("p.txt", 40), ("q.txt", 57)):
        (tmp_path / name).write_text("".join(f"# note {i}\n" if i % 10 == 9 else f"line {i} of {name}\n" for i in range(n)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        rows = files.read_text(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, n in (("p.txt", 40), ("q.txt", 57)):
        got = sorted((int(r["ticket_id"]), r["message"]) for r in rows if r["source_file"].endswith(name))
        assert got == [(i + 1, m) for i, m in enumerate(f"line {i} of {name}" for i in range(n) if i % 10 != 9)]
    assert len({r["pos"] for r in rows}) == len(rows)
