"""The user-facing jobs, end to end over small files, and faults that once lost rows."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import jobs
from tessera.functions import constants as C
from tessera.operators import dedup as D
from tessera.operators import registry as RG
from tessera.sinks.versioned import VersionedTable
from tessera.sources import files as FS
from tessera.sources import mapping as M
from tessera.streaming import fill as ST


def _lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_corpus_to_training_plan(spark, tmp_path):
    emotion = next(e for e, (skip, t) in C.EMOTIONS.items() if not skip and any(abs(v) >= 0.6 for v in t.values()))
    roles = [{"conv_id": f"c{i}", "utterance_idx": 1, "speaker_idx": "a", "context": emotion,
              "utterance": f"this is a plain enough sentence number {i}"} for i in range(30)]
    path = _lines(tmp_path / "roles.json", roles)
    out = str(tmp_path / "out")
    funnel = jobs.build_corpus(spark, {"roles": path, "int_labels": str(tmp_path / "absent")}, out, "jsonl")
    assert {r["reason"]: r["n"] for r in funnel.collect()} == {"processed": 30}
    assert spark.read.parquet(f"{out}/emotion_mapping").count() == len(C.EMOTIONS)
    with pytest.raises(Exception):
        jobs.build_corpus(spark, {"roles": str(tmp_path / "absent")}, out)
    n = spark.read.json(f"{out}/corpus").count()
    assert 0 < n <= 30  # the source is sampled
    sizes = jobs.bucketize(spark, f"{out}/corpus", str(tmp_path / "none"), min_rows=n + 1)
    assert sizes.filter("kept").count() == 0 and ST.read_shards(spark, str(tmp_path / "none")).count() == 0
    kept = jobs.bucketize(spark, f"{out}/corpus", str(tmp_path / "shards"), min_rows=n)
    poles = {r["bucket"] for r in kept.filter("kept").collect()}
    assert poles and {r["bucket"] for r in ST.read_shards(spark, str(tmp_path / "shards")).select("bucket").distinct().collect()} == poles
    counts = jobs.convert(spark, str(tmp_path / "shards"), str(tmp_path / "prompts"))
    assert {r["n"] for r in counts.collect()} == {n, n * len(poles)}
    assert {r["bucket"] for r in jobs.list_available(spark, str(tmp_path / "prompts")).collect()} == poles
    reg = str(tmp_path / "registry")
    plan = jobs.plan_training(spark, str(tmp_path / "prompts"), reg, now=5.0).collect()
    assert {r["bucket"] for r in plan} == poles and {r["action"] for r in plan} == {"launch"}
    again = jobs.plan_training(spark, str(tmp_path / "prompts"), reg, all_poles=True, now=6.0)
    actions = {r["action"] for r in again.collect()}
    assert "missing" in actions
    assert jobs.read_registry(spark, reg).count() == jobs.read_registry(spark, reg, 1).count() == len({r["hash"] for r in plan})  # shards of equal content are one entry


def test_seeds_and_requests(spark, tmp_path):
    rows = [{"emotion": C.NEUTRAL_EMOTIONS[0], "text": f"I think the train number {i} leaves at nine tomorrow", "row_idx": i} for i in range(12)]
    reasons = jobs.make_seeds(spark, _lines(tmp_path / "s.json", rows), str(tmp_path / "seeds"), max_samples=10)
    assert {r["reason"]: r["n"] for r in reasons.collect()} == {"good_seed": 12}
    assert spark.read.json(str(tmp_path / "seeds")).count() == 10
    needs = jobs.request_paraphrases(spark, str(tmp_path / "absent"), [str(tmp_path / "seeds")], str(tmp_path / "req"), [C.BUCKETS[0]], target=2)
    assert [r["need"] for r in needs.collect()] == [2]
    req = spark.read.json(str(tmp_path / "req"))
    assert req.count() == 2 * C.OVERSAMPLE_FACTOR and req.select("seed").distinct().count() == req.count()


def _responses(n, start=0, bucket=None):
    return [{"node": i, "bucket": bucket or C.BUCKETS[0], "seed": "s",
             "text": " ".join(f"w{i}x{k}" for k in range(12))} for i in range(start, start + n)]


def test_fill_beyond_the_default_target(spark):
    n, need = C.TARGET_PER_BUCKET + 300, C.TARGET_PER_BUCKET + 200
    cand = spark.createDataFrame([(r["node"], r["bucket"], r["text"], r["seed"]) for r in _responses(n)], "node long, bucket string, text string, seed string")
    needs = spark.createDataFrame([(C.BUCKETS[0], need)], "bucket string, need long")
    none = spark.createDataFrame([], "bucket string, text string")
    assert D.fill_to_target(cand, none, needs, target=need).count() == need


def test_greedy_chain_runs_to_its_end(spark):
    members = [(i, f"e{j}") for i in range(9) for j in (i, i + 1)]
    df = spark.createDataFrame(members, "node long, band_key string")
    assert sorted(r["node"] for r in D.greedy_accept(df).filter("accepted").collect()) == [0, 2, 4, 6, 8]


def test_fill_stream_replay_and_second_run(spark, tmp_path):
    shards, bands = str(tmp_path / "shards"), str(tmp_path / "bands")
    one, two = (spark.createDataFrame([(r["node"], r["bucket"], r["text"], r["seed"]) for r in _responses(5, s)],
                                      "node long, bucket string, text string, seed string") for s in (0, 100))
    # a crash after the band keys and before the shard rows: the keys must not count
    keys = ST._members(one, "node").select("band_key", "bucket", F.lit("a").alias("run"), F.lit(0).cast("long").alias("epoch"))
    keys.write.parquet(bands)
    first = ST.make_batch_writer(spark, shards, bands, target=8, run="a")
    first(one, 0)
    assert ST.read_shards(spark, shards).count() == 5
    first(one, 0)  # replayed after its commit
    assert ST.read_shards(spark, shards).count() == 5
    second = ST.make_batch_writer(spark, shards, bands, target=8, run="b")
    second(one, 0)  # a new run starts at epoch 0 again: all are duplicates
    assert ST.read_shards(spark, shards).count() == 5
    second(two, 1)  # cut at the need
    assert ST.read_shards(spark, shards).count() == 8


def test_fill_knows_shards_of_earlier_jobs(spark, tmp_path):
    shards, state = str(tmp_path / "shards"), str(tmp_path / "state")
    rows = _responses(4)
    old = spark.createDataFrame([(r["text"], r["bucket"]) for r in rows[:2]], "utterance string, bucket string")
    old.write.partitionBy("bucket").json(shards)
    (tmp_path / "in").mkdir()
    _lines(tmp_path / "in" / "a.json", rows)
    sizes = jobs.fill_buckets(spark, str(tmp_path / "in"), shards, state, target=100)
    assert [r["n"] for r in sizes.collect()] == [4]
    _lines(tmp_path / "in" / "b.json", _responses(3, 50))
    assert [r["n"] for r in jobs.fill_buckets(spark, str(tmp_path / "in"), shards, state, target=100).collect()] == [7]


def test_malformed_lines_are_counted(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"utterance": "fine"}\n{broken\n{"utterance": "too"}\n')
    assert FS.read_corpus_jsonl(spark, str(tmp_path / "c.jsonl"), strict=False).count() == 2
    assert [(r["lines"], r["malformed"]) for r in FS.malformed_lines(spark, str(tmp_path / "c.jsonl")).collect()] == [(3, 1)]


def test_fingerprint_sums_do_not_overflow(spark):
    rows = spark.range(0, 1000).select(F.lit("b").alias("bucket"), F.lit("p").alias("prompt"), F.col("id").cast("string").alias("completion"))
    types = dict(RG.shard_fingerprints(rows).dtypes)
    assert types["hash"] == "string" and RG.shard_fingerprints(rows).count() == 1


def test_registry_audit_and_unfinished(spark):
    reg = spark.createDataFrame([("a", "j1", 1.0), ("b", "j2", 1.0), ("b", "j3", 2.0), ("c", "j4", 1.0)], "trait string, job_id string, created_at double")
    ids = spark.createDataFrame([("a", "j1"), ("b", "j3"), ("d", "j9")], "trait string, job_id string")
    found = {r["trait"]: r["finding"] for r in jobs.registry_audit(reg, ids).collect()}
    assert found == {"b": "duplicate", "c": "not_listed", "d": "not_in_registry"}
    done = spark.createDataFrame([("joy_plus", True), ("joy_minus", False)], "bucket string, finished boolean")
    asked = RG.requested_buckets(spark, ["joy_plus", "joy_minus"])
    assert [r["bucket"] for r in jobs.unfinished(asked, done).collect()] == ["joy_minus"]


def test_every_bucket_listed():
    assert jobs.list_traits() == list(C.BUCKETS) and len(M.__doc__) > 0


def test_fill_stream_query_has_several_batches(spark, monkeypatch):
    """The registered query fills across micro-batches and gives what one pass in order does."""
    from tessera.functions import constants as C
    from tessera.operators import dedup as D
    from tessera.plans import catalog

    buckets = C.BUCKETS[:2]
    texts = [f"text {i % 40} says something about place {i % 40} and person {i % 40}" for i in range(160)]
    cand = spark.createDataFrame([(i, buckets[i % 2], t, f"seed {i}") for i, t in enumerate(texts)], "node long, bucket string, text string, seed string")
    monkeypatch.setattr(catalog, "_candidates", lambda *a: cand)
    sizes, make = [], ST.make_batch_writer

    def counted(spark, shards, bands, target, run):
        write = make(spark, shards, bands, 15, run)

        def one(batch, epoch):
            sizes.append(batch.count())
            write(batch, epoch)
        return one
    monkeypatch.setattr(ST, "make_batch_writer", counted)
    out = sorted(r["original_seed"] for r in catalog.fill_stream(spark, None).collect())
    needs = spark.createDataFrame([(b, 15) for b in buckets], "bucket string, need int")
    want = D.fill_to_target(cand, cand.select("bucket", "text").limit(0), needs)
    assert len([n for n in sizes if n]) == 4 and sum(sizes) == 160
    assert out == sorted(r["seed"] for r in want.collect()) and len(out) == 30


def test_refill_goes_on_after_crashes(spark, tmp_path, monkeypatch):
    """Answers with too many copies need several rounds; a call dies in every step once."""
    seeds = [{"utterance": f"I think the train number {i} leaves at nine tomorrow"} for i in range(40)]
    _lines(tmp_path / "seeds.json", seeds)
    asked = []

    def answer(requests, number):
        asked.append((number, requests.count()))
        if len(asked) == 1:
            raise OSError("killed")
        which = F.pmod(F.col("request_no"), F.lit(3))  # three different texts a round
        return requests.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit(f"n{number}x"), which.cast("string"), F.lit("y"), i.cast("string"))), " "))

    def call():
        return {r["bucket"]: (r["existing"], r["need"]) for r in jobs.refill(
            spark, str(tmp_path / "shards"), [str(tmp_path / "seeds.json")], str(tmp_path / "work"), answer, C.BUCKETS[:2], target=7).collect()}

    with pytest.raises(OSError):
        call()
    with monkeypatch.context() as m:  # after the first round's fill, before its state
        write = VersionedTable.write
        m.setattr(VersionedTable, "write", lambda self, rows, after=None: write(self, rows, after) if after == 0 else (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            call()
    assert call() == {b: (7, 0) for b in C.BUCKETS[:2]}
    assert [n for n, _ in asked] == [1, 1, 2, 3] and asked[0] == asked[1]
    rows = ST.read_shards(spark, str(tmp_path / "shards"))
    assert rows.count() == 14 and rows.select("bucket", "utterance").distinct().count() == 14
    assert call() == {b: (7, 0) for b in C.BUCKETS[:2]} and len(asked) == 4  # nothing left to do


def test_refill_ends_where_answers_add_nothing(spark, tmp_path):
    _lines(tmp_path / "seeds.json", [{"utterance": "I think the train number 1 leaves at nine tomorrow"}])
    same = lambda requests, _: requests.withColumn("text", F.lit("always the same answer in these very words"))
    got = jobs.refill(spark, str(tmp_path / "shards"), [str(tmp_path / "seeds.json")], str(tmp_path / "work"), same, C.BUCKETS[:1], target=3).collect()
    assert [(r["existing"], r["need"]) for r in got] == [(1, 2)]
