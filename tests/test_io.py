import json

from turnloom.functions.sentiment import Lexicon
from turnloom.operators import binning
from turnloom.plans import intent as plan
from turnloom.sources import sinks, tables
from turnloom.streaming import scoring


def test_conversations_keep_row_order_over_files(spark, tmp_path):
    for f in range(3):
        cells = [f'"User 1: f{f} r{r}\nUser 2: say ""hi"", ok"' for r in range(5)]
        cells.insert(2, '""')
        cells.insert(4, "NA")
        (tmp_path / f"part-{f}.csv").write_text("\n".join(cells) + "\n")
    rows = sorted(tables.read_conversations(spark, str(tmp_path)).collect())
    assert [r.conversation_id for r in rows] == list(range(15))
    assert [r.raw.split("\n")[0] for r in rows] == [f"User 1: f{f} r{r}" for f in range(3) for r in range(5)]
    assert rows[0].raw.endswith('say "hi", ok')


def test_labelled_round_trip(spark, tmp_path):
    path = str(tmp_path / "labeled")
    rows = spark.createDataFrame([('say "hi",\nnow', "unknown", "fallback"), (None, "unknown", "x")],
                                 "text STRING, label STRING, source_rule STRING")
    sinks.write_csv(rows, path)
    assert [tuple(r) for r in tables.read_labeled(spark, path).collect()] == [('say "hi",\nnow', "unknown", "fallback")]
    assert tables.read_labeled(spark, path, keep_missing=True).count() == 2


def test_dev_prefers_hand_labels(spark, tmp_path):
    hand, auto = str(tmp_path / "hand"), str(tmp_path / "auto")
    sinks.write_csv(spark.createDataFrame([("a", "unknown")], "text STRING, label STRING"), auto)
    assert tables.load_dev(spark, hand, auto).first().dev_source == "auto"
    sinks.write_dev_sheet(spark.createDataFrame([("a",)], "text STRING"), hand)
    assert tables.load_dev(spark, hand, auto).first().dev_source == "auto"  # no label filled in yet
    sinks.write_csv(spark.createDataFrame([("a", None), ("b", "reminder")], "text STRING, label STRING"), hand)
    assert [(r.text, r.dev_source) for r in tables.load_dev(spark, hand, auto).collect()] == [("b", "hand")]


def test_chunks_and_vectors(spark, tmp_path):
    chunk = {"id": "c0_t0", "text": "x", "conversation_id": 0, "turn_index": 0, "day_bucket": 1, "sentiment": 0.5, "synthetic": False}
    (tmp_path / "chunks.json").write_text(json.dumps({"info": {}, "chunks": [chunk]}))
    chunks = tables.read_chunks(spark, str(tmp_path / "chunks.json"))
    assert chunks.first().asDict() == chunk
    path = str(tmp_path / "vectors")
    sinks.write_vectors(spark.createDataFrame([("a", [0.5, 1.0])], "id STRING, embedding ARRAY<DOUBLE>"), path)
    assert dict(tables.read_vectors(spark, path).dtypes)["embedding"] == "array<float>"


def test_write_if_stale(spark, tmp_path):
    path = str(tmp_path / "t")
    three, four = spark.range(3), spark.range(4)
    assert [sinks.write_if_stale(three, path), sinks.write_if_stale(three, path), sinks.write_if_stale(four, path),
            sinks.write_if_stale(four, path, force=True)] == [True, False, True, True]
    assert tables.read_vectors(spark, path).count() == 4


def test_timeline_missing_and_stored(spark, tmp_path):
    assert tables.read_timeline(spark, str(tmp_path / "none")).count() == 0
    info = binning.Binning("row", "r", 7, "synthetic_row_order")
    sinks.write_timeline(spark.createDataFrame([(0, "happy")], "day INT, mood STRING"), info, str(tmp_path / "t"))
    assert tables.read_timeline(spark, str(tmp_path / "t")).first().info.strategy == "row"


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lex.txt").write_text(":)\t2.0\t1.2\t[2]\ngood\t1.9\t0.9\t[1, 2]\n")
    assert tables.read_lexicon(spark, str(tmp_path / "lex.txt")).valences == {":)": 2.0, "good": 1.9}


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(i, f"send good news {i}") for i in range(6)], "id BIGINT, text STRING")
    rows.write.json(source)
    stream = spark.readStream.schema("id BIGINT, text STRING").json(source)
    query = scoring.write_stream(scoring.score_stream(stream, Lexicon()), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination(60)
    streamed = sorted(spark.read.parquet(str(tmp_path / "out")).collect())
    assert streamed == sorted(scoring.score_stream(rows, Lexicon()).collect())
    assert {r.label for r in streamed} == {r.label for r in plan.label_lines(rows).collect()} == {"action-item"}


def test_periods_are_rewritten_by_content(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [("01", i, f"text {i}", [i]) for i in range(5)] + [("02", 9, "a", None), ("02", 9, "a", None), (None, None, None, [1])]

    def table(rows):
        return spark.createDataFrame(rows, "day STRING, id INT, text STRING, tags ARRAY<INT>").repartition(3)

    def stored():
        return sorted(map(tuple, sinks.read_periods(spark, path, "day").select("day", "id", "text", "tags").collect()), key=repr)

    assert sinks.write_stale_periods(table(rows), path, "day") == [None, "01", "02"]
    assert stored() == sorted(rows, key=repr)
    assert sinks.write_stale_periods(table(rows[::-1]), path, "day") == []  # the order of rows does not matter
    changed = [(d, i, "text x" if i == 3 else t, g) for d, i, t, g in rows]
    assert sinks.write_stale_periods(table(changed), path, "day") == ["01"]  # as many rows, one text differs
    assert stored() == sorted(changed, key=repr)
    assert sinks.write_stale_periods(table(changed[:6]), path, "day") == [None, "02"]  # one repeated row less, a period gone
    assert stored() == sorted(changed[:6], key=repr)
    assert sinks.write_stale_periods(table(rows).limit(0), path, "day") == ["01", "02"] and stored() == []
    assert sinks.fingerprints(table([("1", 1, "ab", None)]), "day").collect() != sinks.fingerprints(table([("1", 1, "a", None)]), "day").collect()


def test_cells_that_say_missing(spark, tmp_path):
    path = str(tmp_path / "marked.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("text,label,source_rule\nhello,greet,r\nNA,greet,r\nbye,nan,r\nN/A or not,other,NULL\n")
    assert {(r.text, r.source_rule) for r in tables.read_labeled(spark, path).collect()} == {("hello", "r"), ("N/A or not", None)}
    assert tables.read_labeled(spark, path, keep_missing=True).count() == 4
    marked = str(tmp_path / "hand.csv")
    with open(marked, "w", encoding="utf-8") as f:
        f.write("text,label\na,NA\n")
    assert tables.load_dev(spark, marked, path).first().dev_source == "auto"  # the only label says "missing"


def test_seed_prefix(spark):
    assert {r.id for r in tables.seed_chunks(spark, [(1, "a"), (2, "b")], prefix="s-").collect()} == {"s-0", "s-1"}
