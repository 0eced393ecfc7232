import datetime
import json

import pytest
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions import features as feat
from riskloom.operators import cases, feedback, panel, routing, velocity
from riskloom.plans.frames import SCORE_CARD, Frames
from riskloom.sources import messages, streams
from riskloom.streaming import jobs, state
from tests.fixtures import message


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def drain(stream, checkpoint, mode="append"):
    """Run to the end of the input and gather every batch."""
    rows = []
    query = jobs.run(stream, str(checkpoint), lambda df, i: rows.extend((i, *r) for r in df.collect()), mode=mode)
    query.awaitTermination(120)
    return rows


def numbered(stream, folder, size, *columns):
    """Number every batch of a stream and gather the rows."""
    rows = []

    def each(batch, batch_id):
        counted = state.number_batch(batch, batch_id, str(folder / "kept"), size)
        rows.extend((batch_id, *r) for r in counted.select(*columns, "velocityCount").collect())

    jobs.run(stream, str(folder / "c"), each).awaitTermination(120)
    return rows


def stream_of(spark, folder, files=1):
    valid, _ = messages.decode_transactions(streams.read_messages(spark, str(folder), files_per_trigger=files))
    return valid


def test_running_velocity_over_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "1.json", message(1, "A", "2026-07-04T10:00:00"), message(2, "B", "2026-07-04T10:01:00"))
    put(inbox, "2.json", message(3, "A", "2026-07-04T10:04:59"))
    first = numbered(stream_of(spark, inbox), tmp_path, "5 minutes", "transactionId")
    assert sorted(r[1:] for r in first) == [("T-001", 1), ("T-002", 1), ("T-003", 2)]
    # The same query goes on from its checkpoint: a new window starts, and then the old one is over.
    put(inbox, "3.json", message(4, "A", "2026-07-04T10:05:00"))
    put(inbox, "4.json", message(5, "A", "2026-07-04T10:04:00"), message(6, "A", "2026-07-04T10:06:00"))
    later = numbered(stream_of(spark, inbox), tmp_path, "5 minutes", "transactionId")
    assert sorted(r[1:] for r in later) == [("T-004", 1), ("T-005", 1), ("T-006", 2)]  # 5 is late: uncounted, not lost


def test_streaming_velocity_equals_batch(spark, small, tmp_path):
    txn = Frames(spark, small).transactions()
    files = str(tmp_path / "txn")
    txn.orderBy("timestamp").coalesce(1).write.parquet(files)
    source = spark.readStream.schema(txn.schema).parquet(files)
    columns = ["transactionId", "timestamp", "amount", "metadata.sequence"]
    got = numbered(source, tmp_path, "1 day", *columns)
    want = velocity.velocity_running(txn, "1 day").select(*columns, "velocityCount")
    assert sorted(r[1:] for r in got) == sorted(map(tuple, want.collect()))


def test_busy_customer_is_cut_before_rows_are_numbered(spark, tmp_path):
    """One customer with a third of a backlog: rows equal the batch form, and no task gets their rows."""
    rows = 300_000
    customer = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), F.col("id") % 5_000))
    txn = spark.range(rows).select(
        customer.alias("customerId"), F.concat(F.lit("T"), F.col("id")).alias("transactionId"),
        F.timestamp_millis(F.lit(1_767_225_600_000) + F.col("id") * 7).alias("timestamp")).withColumn(
        "half", (F.col("timestamp") >= F.timestamp_millis(F.lit(1_767_225_600_000 + rows * 7 // 2))).cast("int"))
    txn.repartition(4).write.partitionBy("half").parquet(str(tmp_path / "t"))
    halves = [spark.read.parquet(str(tmp_path / "t")).where(F.col("half") == h).drop("half") for h in (0, 1)]
    got = None
    for batch_id, half in enumerate(halves):
        part = state.number_batch(half, batch_id, str(tmp_path / "kept"), "1 hour", "10 seconds")
        got = part if got is None else got.unionByName(part)
    want = velocity.velocity_running(txn.drop("half"), "1 hour")
    columns = ["customerId", "transactionId", "velocityCount"]
    assert got.select(*columns).exceptAll(want.select(*columns)).isEmpty() and got.count() == rows
    pieces = halves[0].groupBy("customerId", F.window("timestamp", "10 seconds")).count()
    assert pieces.agg(F.max("count")).first()[0] < rows // 500


def test_replayed_batch_is_numbered_as_before(spark, tmp_path):
    schema = "customerId string, transactionId string, timestamp timestamp"
    at = lambda minute: datetime.datetime(2026, 7, 4, 10, minute)
    first = spark.createDataFrame([("A", "1", at(0)), (None, "2", at(1))], schema)
    second = spark.createDataFrame([("A", "3", at(2)), ("A", "4", at(9)), (None, "5", at(3))], schema)
    state.number_batch(first, 0, str(tmp_path), "5 minutes").collect()
    tries = [sorted((r["transactionId"], r["velocityCount"]) for r in state.number_batch(second, 1, str(tmp_path), "5 minutes").collect())
             for _ in range(2)]
    assert tries[0] == tries[1] == [("3", 2), ("4", 1), ("5", 2)]
    empty = state.number_batch(first.limit(0), 2, str(tmp_path), "5 minutes")
    assert empty.collect() == [] and not (tmp_path / "batch_id=0").exists()
    kept = state.stored_counts(spark, str(tmp_path), 3).collect()
    assert {(r["customerId"], r["n"]) for r in kept} == {("A", 1), (None, 2)}


def test_latest_velocity_keeps_old_counts(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "1.json", message(1, "A", "2026-07-04T10:00:00"), message(2, "A", "2026-07-04T10:01:00"), message(3, "B", "2026-07-04T10:01:00"))
    put(inbox, "2.json", message(4, "B", "2026-07-04T11:00:00"))
    rows = drain(state.latest_velocity(stream_of(spark, inbox), "5 minutes"), tmp_path / "c", "update")
    final = {}
    for _, customer, n in sorted(rows):
        final[customer] = n
    assert final == {"A": 2, "B": 1}


def test_window_counts_update_mode(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "1.json", *[message(i, "A", f"2026-07-04T10:0{i}:00") for i in range(3)])
    put(inbox, "2.json", message(7, "A", "2026-07-04T10:05:00"))
    rows = drain(jobs.velocity_counts(stream_of(spark, inbox)), tmp_path / "c", "update")
    assert sorted(r[3] for r in rows) == [1, 3]


def test_whole_path_to_every_sink(spark, small, tmp_path):
    frames = Frames(spark, small)
    txn, out = frames.transactions(), tmp_path / "out"
    txn.orderBy("timestamp").coalesce(2).write.parquet(str(tmp_path / "txn"))
    source = spark.readStream.schema(txn.schema).parquet(str(tmp_path / "txn"))
    scorer = jobs.card_scorer(SCORE_CARD, dict.fromkeys(SCORE_CARD.coefficients, 0.5))
    each = jobs.enriched_batches(str(tmp_path / "kept"), frames.profiles(), jobs.process_batch(str(out), scorer, "card-v1"), "1 day")
    jobs.run(source, str(tmp_path / "c"), each).awaitTermination(200)
    total = txn.count()

    def read(name):
        return spark.read.parquet(str(out / name))

    assert read("enriched-transactions").count() == total
    assert read("ml-predictions").count() == total
    assert read("analyst-feedback").count() == total
    assert sum(read(n).count() for n in ("fraud-alerts", "human-review", "approved-transactions")) == total
    assert {n: read(f"audit/{n}").count() for n in ("transactions", "model_predictions", "fraud_decisions")} == dict.fromkeys(
        ("transactions", "model_predictions", "fraud_decisions"), total)
    want = {r["route"]: r["decisions"] for r in frames.decided().groupBy("route").agg(F.count(F.lit(1)).alias("decisions")).collect()}
    assert {n: read(n).count() for n in want} == want
    decisions, bad = messages.decode_decisions(read("fraud-decisions").select("value"))
    assert decisions.count() == total and bad.count() == 0
    assert routing.with_route(decisions).groupBy("route").count().count() == 3
    back, bad = messages.decode_enriched(read("enriched-transactions").select("value"))
    assert back.count() == total and bad.count() == 0
    assert read("audit/model_predictions").where("prediction_time_ms > 0").count() == total
    streamed = read("audit/fraud_decisions").where("NOT rag_context_used").select("transaction_id", "llm_confidence", "decision")
    assert streamed.exceptAll(frames.audit_decisions().select(*streamed.columns)).isEmpty()
    newest = streams.read_audit(spark, str(out / "audit"), "fraud_decisions", newest_first="decided_at", limit=5, decision="REVIEW")
    assert newest.count() == 5


def test_replayed_batch_is_written_once(spark, tmp_path):
    from riskloom.sources import sinks

    df = spark.range(5)
    for _ in range(2):
        sinks.write_batch(df, str(tmp_path / "t"), 3)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_failed_audit_write_does_not_raise(spark):
    from riskloom.sources import sinks

    def broken(df, table, batch_id):
        raise OSError("no database")

    assert sinks.write_audit({"transactions": spark.range(1)}, "x", 0, broken) == ["transactions"]


@pytest.fixture
def pair_files(spark, small, tmp_path):
    frames = Frames(spark, small)
    predictions = frames.predictions().withColumn("predictedAt", F.col("predictedAt").cast("timestamp"))
    given = frames.feedback().withColumn("feedbackAt", F.col("feedbackAt").cast("timestamp"))
    predictions.coalesce(1).write.parquet(str(tmp_path / "p"))
    given.coalesce(1).write.parquet(str(tmp_path / "f"))
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    return frames, read(predictions, "p"), read(given, "f")


def test_pairing_stream_equals_batch(spark, pair_files, tmp_path):
    frames, predictions, given = pair_files
    got = drain(jobs.paired_stream(predictions, given).select("transactionId"), tmp_path / "c")
    assert sorted(r[1] for r in got) == sorted(r[0] for r in feedback.pair(frames.predictions(), frames.feedback()).select("transactionId").collect())


def test_case_store_grows_without_duplicates(spark, pair_files, tmp_path):
    frames, predictions, given = pair_files
    store = str(tmp_path / "store")
    jobs.run(jobs.paired_stream(predictions, given), str(tmp_path / "c"), jobs.store_cases(store)).awaitTermination(120)
    kept = spark.read.parquet(store)
    want = cases.confirmed_cases(feedback.pair(frames.predictions(), frames.feedback()))
    assert sorted(r[0] for r in kept.select("id").collect()) == sorted(r[0] for r in want.select("id").collect())
    # A second run over the same pairs adds nothing.
    paired = feedback.pair(frames.predictions(), frames.feedback())
    jobs.store_cases(store)(paired, 99)
    assert spark.read.parquet(store).count() == want.count()


def test_online_learning_improves_and_resumes(spark, small, tmp_path):
    folder = str(tmp_path / "online")
    rows = Frames(spark, small).paired()
    each = jobs.learn_online(folder)
    for batch in range(3):
        each(rows, batch)
    scores = [spark.read.parquet(f"{folder}/scores/batch_id={b}") for b in range(3)]
    loss = [s.agg(F.avg(F.pow(F.col("label") - F.col("onlineScore"), 2))).first()[0] for s in scores]
    assert loss[2] < loss[0]
    model = jobs.load_online(spark, folder, 3)
    assert model.updates == 3 * rows.count()
    assert len(model.trees) == len(model.windows) == 10 and model.load(model.dump()) == model


def test_quarantine_keeps_reason_and_prefix(spark):
    good = message(1, "A", "2026-07-04T10:00:00")
    lines = [good, message(2, "A", "2026-07-04T10:00:00", currency=None), good[:60], "not json", message(3, "A", "yesterday"),
             json.dumps({"transactionId": "x" * 300})]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    valid, bad = messages.decode_transactions(df)
    assert [r["transactionId"] for r in valid.collect()] == ["T-001"]
    reasons = [",".join(r["reasons"]) for r in bad.collect()]
    assert reasons[:4] == ["currency_missing", "malformed", "malformed", "timestamp_missing"]
    assert all(r["preview"] == r["raw"][:200] for r in bad.collect())


def test_union_is_tagged(spark, small):
    frames = Frames(spark, small)
    tags = feedback.union_tagged(frames.predictions(), frames.feedback()).select("topic").distinct().collect()
    assert {t[0] for t in tags} == {"ml-predictions", "analyst-feedback"}
    assert panel.AGENTS and schemas.AUDIT and feat.feature_columns()


def test_stored_cases_reach_the_decision(spark, small, tmp_path):
    from riskloom.operators import ml

    frames = Frames(spark, small)
    stored = cases.confirmed_cases(feedback.pair(frames.predictions(), frames.feedback()), F.col("feedbackAt")).cache()
    embedder = ml.fit_text_embedder(stored.select("document"))
    scorer = jobs.card_scorer(SCORE_CARD, dict.fromkeys(SCORE_CARD.coefficients, 0.5))
    each = jobs.process_batch(str(tmp_path), scorer, "card-v1", jobs.case_retriever(stored, embedder))
    each(frames.enriched().where("merchantCategory = 'ONLINE'"), 0)
    sent, bad = messages.decode_predictions(spark.read.parquet(str(tmp_path / "ml-predictions")).select("value"))
    assert bad.count() == 0
    with_cases = sent.where("ragContext.casesFound > 0")
    assert with_cases.count() > 0
    row = with_cases.first()
    assert row["ragContext"]["cases"][0]["similarity"] >= 0.4 and len(row["shapExplanation"]) == 3
    assert row["ragContext"]["promptContext"].startswith("SIMILAR CONFIRMED FRAUD CASES")
    told, _ = messages.decode_decisions(spark.read.parquet(str(tmp_path / "fraud-decisions")).select("value"))
    assert told.where("riskFactors['ragCasesFound'] > 0 AND contains(detailedExplanation, 'SIMILAR CONFIRMED')").count() == with_cases.count()
    audited = spark.read.parquet(str(tmp_path / "audit/fraud_decisions"))
    assert audited.where("rag_context_used AND rag_similarity_score >= 0.4").count() == with_cases.count()


def test_without_a_model_rows_are_skipped(spark, small, tmp_path):
    each = jobs.process_batch(str(tmp_path), jobs.tree_scorer(None), "none")
    each(Frames(spark, small).enriched(), 0)
    assert spark.read.parquet(str(tmp_path / "fraud-decisions")).count() == 0
