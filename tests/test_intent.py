import pytest

from turnloom import constants as K
from turnloom.functions import rules
from turnloom.operators import evaluation, intent, sampling
from turnloom.plans import intent as plan
from turnloom.sources import sinks, tables

# Published confusion matrix, rows true, in label order.
MATRIX = [[0, 0, 0, 0, 0], [0, 14, 0, 0, 0], [0, 0, 3, 0, 0], [3, 5, 2, 29, 1], [27, 11, 26, 0, 29]]


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [(t, p) for t, counts in zip(K.LABELS, MATRIX) for p, n in zip(K.LABELS, counts) for _ in range(n)]
    return spark.createDataFrame(rows, "label STRING, prediction STRING")


def test_published_metrics(predictions):
    got = [(r.precision, r.recall, r.f1, r.support) for r in evaluation.class_metrics(predictions).collect()]
    assert got == [(0.0, 0.0, 0.0, 0), (0.4667, 1.0, 0.6364, 14), (0.0968, 1.0, 0.1765, 3),
                   (1.0, 0.725, 0.8406, 40), (0.9667, 0.3118, 0.4715, 93)]
    assert tuple(evaluation.macro_f1(predictions).first()) == (5, 0.425)
    cells = evaluation.confusion_matrix(predictions).collect()
    assert [c.n for c in cells] == [n for row in MATRIX for n in row]


def test_distribution_shows_absent_labels(spark):
    df = spark.createDataFrame([("unknown",), ("unknown",), ("reminder",)], "label STRING")
    assert [(r.label, r.n, r.percent) for r in evaluation.label_distribution(df).collect()] == [
        ("reminder", 1, 33.3), ("emotional-support", 0, 0.0), ("action-item", 0, 0.0), ("small-talk", 0, 0.0),
        ("unknown", 2, 66.7)]


def labelled(spark, n=400):
    texts = ["remind me about item {}", "send the file {} to them", "i feel so sad about thing {}", "hello there number {}",
             "the river {} flows past a quiet mill"]
    rows = [(i, texts[i % 5].format(i % 37)) for i in range(n)]
    return plan.label_lines(spark.createDataFrame(rows, "id BIGINT, text STRING"))


def test_stratified_head(spark):
    rows = labelled(spark).repartition(7, "text")
    sample = sampling.stratified_head(rows, 6, tie=["id"]).collect()
    assert [r.label for r in sample] == [label for label in K.LABELS for _ in range(6)]
    again = sampling.stratified_head(rows.repartition(2), 6, tie=["id"]).collect()
    assert [r.id for r in sample] == [r.id for r in again]
    other = sampling.stratified_head(rows, 6, seed=1, tie=["id"]).collect()
    assert [r.id for r in sample] != [r.id for r in other]


def test_gold_and_agreement(spark):
    gold = sampling.gold_table(labelled(spark, 50))
    assert gold.columns == ["text", "label", "weak_label", "auto_gold_reason", "needs_review"]
    n_agree, n, rate = evaluation.agreement(gold).first()
    assert n == 50 and rate == round(n_agree / n, 4)


def test_sample_messages(spark):
    raws = [(i, "\n".join(f"User 1: line {i} {j}" for j in range(i % 4)) + "\n \n") for i in range(60)]
    df = spark.createDataFrame(raws, "conversation_id BIGINT, raw STRING")
    found = sampling.sample_messages(df, 40).collect()
    assert len(found) == 40 and all(r.text.startswith("line") for r in found)
    assert [r.line for r in found if r.conversation_id == found[0].conversation_id] == list(
        range(found[0].conversation_id % 4))
    assert sampling.sample_messages(df, 1000).count() == sum(i % 4 for i in range(60))


def test_vocabulary(spark):
    df = spark.createDataFrame([("a bb bb cc",), ("bb cc",), ("dd",)], "text STRING")
    got = [(r.term, r.tf, r.df) for r in intent.vocabulary(df).collect()]
    assert got == [("bb", 3, 2), ("bb cc", 2, 2), ("cc", 2, 2)]
    assert intent.vocabulary(df, max_features=1).count() == 1


def test_train_classify_evaluate(spark, tmp_path):
    rows = labelled(spark)
    model, record = plan.train_and_evaluate(rows, max_iter=60)
    r = record.first()
    assert (r.dev_source, r.n_train, r.n_dev) == ("auto", 400, 150)
    assert r.macro_f1_dev > 0.7 and set(r.per_class) == set(K.LABELS)
    assert len(r.confusion_matrix["values"]) == 5 and sum(map(sum, r.confusion_matrix["values"])) == 150
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    scored = intent.classify(rows.select("id", "text"), PipelineModel.load(path)).collect()
    right = sum(a.label == b.label for a, b in zip(sorted(scored), sorted(rows.select("id", "text", "label").collect())))
    assert right / len(scored) > 0.95
    assert all(0.2 <= s.confidence <= 1 for s in scored)


def test_rules_are_a_parameter(spark):
    mine = (rules.Rule("billing", "kw:bill", ("invoice|bill",)),)
    df = spark.createDataFrame([("the invoice",), ("other",)], "text STRING")
    assert [r.label for r in plan.label_lines(df, mine).collect()] == ["billing", "unknown"]


def test_sample_passes_over_cells_with_prefixes_only(spark):
    rows = [(i, "User 1: \n User 2:") for i in range(50)] + [(100 + i, f"User 1: line {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "conversation_id LONG, raw STRING")
    assert sampling.sample_messages(df, 20).count() == 20
    assert sampling.sample_messages(df, 90).count() == 50


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"please call number {i % 3}", "reminder") for i in range(9)]
                                 + [(f"lovely day again {i % 3}", "small-talk") for i in range(9)], "text STRING, label STRING")
    model = intent.train(rows, min_df=1)
    sinks.write_model(model, spark, str(tmp_path / "m"))
    again, vocabulary = tables.read_model(spark, str(tmp_path / "m"))
    assert [r.term for r in vocabulary.orderBy("position").collect()] == list(model.stages[0].vocabulary)
    assert intent.classify(rows, again).collect() == intent.classify(rows, model).collect()


def test_training_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = labelled(spark, 200).select("text", "label").mapInPandas(passed, "text STRING, label STRING")
    model = intent.train(rows, max_iter=3)
    assert seen.value == 200
    assert model.stages[0].vocabulary == [r.term for r in intent.vocabulary(labelled(spark, 200)).collect()]


def test_vocabulary_of_texts_with_and_without_repeats(spark):
    rows = spark.createDataFrame([("aa bb aa bb cc",), ("aa cc",), ("Éa ea",), ("",), (None,)], "text STRING")
    got = {r.term: (r.tf, r.df) for r in intent.vocabulary(rows, min_df=1).collect()}
    assert got == {"aa": (3, 2), "bb": (2, 1), "cc": (2, 2), "ea": (2, 1), "aa bb": (2, 1), "bb aa": (1, 1), "bb cc": (1, 1),
                   "aa cc": (1, 1), "ea ea": (1, 1)}
