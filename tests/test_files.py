import json

import numpy as np
from conftest import rows
from pyspark.sql import functions as F
from speechloom import schema as S
from speechloom.operators import models as MO
from speechloom.sinks import writers as W
from speechloom.sources import files as R
from speechloom.sources import textgrid as TG
from speechloom.streaming import periods as P

ROWS = [("a-ST1", "words", 0, 0, 0.0, 1.0, 'say "hi"'), ("a-ST1", "words", 0, 1, 1.0, 2.5, ""), ("a-ST1", "clauses", 1, 0, 0.0, 2.5, "あの line"), ("b", "words", 0, 0, 0.0, 0.5, "um")]


def intervals(spark):
    return spark.createDataFrame(ROWS, S.INTERVALS)


def test_textgrid_files(spark, tmp_path):
    TG.register(spark)
    W.textgrid_text(intervals(spark)).write.format("textgrid").mode("append").save(str(tmp_path))
    back = spark.read.format("textgrid").load(str(tmp_path))
    assert rows(TG.read_textgrids(spark, str(tmp_path)).select(*S.INTERVALS.fieldNames())) == rows(back.select(*S.INTERVALS.fieldNames()))
    assert rows(back.select(*S.INTERVALS.fieldNames())) == sorted(ROWS, key=repr)
    only = back.filter("file_id = 'b' and tier = 'words'")
    assert only.count() == 1 and back.filter("tier in ('clauses')").count() == 1


def test_short_form_and_errors(spark):
    t = W.textgrid_short_text(intervals(spark)).unionByName(spark.createDataFrame([("bad", '"TextGrid" 0 1 1 "IntervalTier"'), ("none", ""), ("null", None)], "file_id string, value string"))
    got = TG.intervals_of_text(t)
    assert rows(got.filter("error is null").select(*S.INTERVALS.fieldNames())) == sorted(ROWS, key=repr)
    assert [r.file_id for r in got.filter("error is not null").collect()] == ["bad"]


def test_asr_and_aligner_json(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f1.json").write_text(json.dumps({"duration": 3.0, "words": [{"word": " b ", "start": 2, "end": 3}, {"word": "a", "start": 0.5, "end": 1}, {"word": "", "start": 1, "end": 2}, {"word": "z", "start": 2, "end": 1}]}, indent=1))
    assert rows(R.asr_words(R.read_asr_json(spark, str(tmp_path / "x")))) == [("f1", 0, 0.5, 1.0, "a"), ("f1", 1, 2.0, 3.0, "b")]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "f2.json").write_text(json.dumps({"tiers": {"words": {"entries": [[0, 1, "hi"], [1, 2, ""], [2, 3, "<eps>"]]}}}))
    assert rows(R.read_aligner_json(spark, str(tmp_path / "y"))) == [("f2", 0, 0.0, 1.0, "hi")]


def test_lists_segments_lines(spark, tmp_path):
    (tmp_path / "l1.json").write_text('{"all_selected": ["a ", "b", ""], "n": 2}')
    (tmp_path / "l2.json").write_text('["c"]')
    assert rows(R.read_file_list(spark, str(tmp_path / "l1.json"))) == [("a",), ("b",)]
    assert rows(R.read_file_list(spark, str(tmp_path / "l2.json"))) == [("c",)]
    for k, text in (("g1", "﻿One  two\n\nThree\n"), ("g2", "other\n")):
        (tmp_path / k).mkdir()
        (tmp_path / k / "f.txt").write_text(text, encoding="utf-8")
    assert rows(R.read_gold_segments(spark, [str(tmp_path / "g1"), str(tmp_path / "g2")])) == [("f", 0, "one two"), ("f", 1, "three")]
    (tmp_path / "t.dis").write_text("a b\nc\n")
    (tmp_path / "t.flu").write_text("b\nc\nd\n")
    assert rows(R.parallel_lines(spark, {"dis": str(tmp_path / "t.dis"), "flu": str(tmp_path / "t.flu")})) == [(0, "a b", "b"), (1, "c", "c")]


def test_swda_csv(spark, tmp_path):
    head = ",".join(S.SWDA_RAW.fieldNames())
    (tmp_path / "sw_1_2001.utt.csv").write_text(head + '\nsw,4/x,2001,1,sd*,A,1,1,"I, well /",I/PRP,(S (PRP I))|||(X y),3|||4\nsw,4/x,2001,2,x@,A,1,2,no,,,\nsw,4/x,2001,3,b,B,oops,1,no,,,\n')
    got = R.read_swda(spark, str(tmp_path)).collect()
    assert [(r.act_tag, r.utterance_index, r.text, r.trees, r.ptb_treenumbers) for r in got] == [("sd", 1, "I, well /", ["(S (PRP I))", "(X y)"], [3, 4])]


def test_csv_and_reports(spark, tmp_path):
    c = spark.createDataFrame([("f", 0, 0, 1.0, 2.0, 1.0, 0.5, 1, 0.2, 1.1, 1.3, None, 1, "")], S.CANDIDATES)
    W.write_csv(c, str(tmp_path / "c"))
    assert R.read_candidates(spark, str(tmp_path / "c")).first().prob_filler is None
    W.write_csv(W.empty_candidates(spark), str(tmp_path / "e"))
    assert [p.read_text().strip().split(",") for p in (tmp_path / "e").glob("*.csv")] == [S.CANDIDATES.fieldNames()]
    assert json.loads(W.summary_json(c.agg(F.count("*").alias("n")), {"t": "0.5"}).first().value) == {"totals": {"n": 1}, "parameters": {"t": "0.5"}}
    assert W.markdown(c.select("file_id", "gap_end")).splitlines()[2] == "| f | 2.000 |"
    review = W.candidates_from_review(W.review_tiers(c, spark.createDataFrame([], "file_id string, s double, e double, label string")).filter("tier = 'review'"))
    assert [(r.candidate_start, r.candidate_end, r.skip_reason) for r in review.collect()] == [(1.1, 1.3, "manual_review")]


def test_label_pair(spark, tmp_path):
    d = spark.createDataFrame([(2, ["b"], [0]), (1, ["a", "x"], [0, 1])], "i int, words array<string>, labels array<int>")
    W.write_label_pair(d, ["i"], str(tmp_path / "p"))
    lines = [[r.value for r in spark.read.text(str(tmp_path / f"p.{x}")).collect()] for x in ("dis", "labels")]
    assert sorted(zip(*lines)) == [("a x", "0 1"), ("b", "0")]


def test_models(spark):
    quiet, loud = np.zeros(8000), np.sin(np.arange(8000))
    (got,) = MO.islands(np.concatenate([quiet, loud, quiet]), 16_000)
    assert abs(got[0] - 0.5) < 0.05 and abs(got[1] - 1.0) < 0.05
    assert MO.islands(np.empty(0), 16_000) == []
    m = MO.log_mel(loud, 16_000)
    assert m.shape == (64, 101) and abs(float(m[:, :50].std())) > 0.1
    d = spark.createDataFrame([("a", [0.5] * 4000), ("b", [0.1] * 10)], "k string, clip array<float>")
    assert [r.prob is None for r in MO.score(d, "clip", 16_000, MO.energy_scorer).orderBy("k").collect()] == [False, True]


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([("u", 0, 5.0), ("u", 3, 5.0), ("u", 100, 5.0), ("u", 90_000, 1.0)], "k string, t int, seconds double").select("k", F.timestamp_seconds("t").alias("at"), "seconds")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = P.streaming_periods(stream, "k", "at", "seconds").writeStream.format("memory").queryName("periods").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.period_start.second, r.n) for r in spark.table("periods").collect()) == [(0, 2), (40, 1)]


def test_one_candidate_file_per_recording(spark, tmp_path):
    c = spark.createDataFrame([(f"f{i % 40}", i, 0, 1.0, 2.0, 1.0, 0.5, 1, 0.2, float("nan"), 1.3, None, 1, "x") for i in range(400)], S.CANDIDATES)
    W.write_csv_per_file(c.repartition(10), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("file_id=*/*.csv"))) == 40
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    back = R.read_candidates(spark, str(tmp_path / "c"))
    assert repr(rows(back.select(*c.columns))) == repr(rows(c)) and back.rdd.getNumPartitions() <= 4 and spark.conf.get(setting) == before


def test_event_clips_in_blocks(spark):
    rate, size, sound = 10, 16, np.arange(100, dtype=np.float32)
    audio = spark.createDataFrame([("a", sound.tolist()), ("b", sound[:5].tolist())], "k string, samples array<float>")
    times = [("a", 0.0, 1.6), ("a", 1.5, 1.7), ("a", 0.3, 9.0), ("a", 0.3, 9.0), ("a", -1.0, 50.0), ("a", 9.6, 9.9), ("a", 5.0, 4.0), ("a", None, 1.0), ("a", 1.0, float("nan")), ("b", 0.0, 0.5), ("c", 0.0, 1.0)]
    events = spark.createDataFrame(times, "k string, s double, e double")
    lengths = audio.select("k", F.size("samples").alias("n"))
    got = MO.event_clips(events, MO.audio_blocks(audio, ["k"], size), lengths, ["k"], "s", "e", rate, 0.2, size)
    at = lambda t, n: min(max(round(t * rate), 0), n)
    want = []
    for k, s, e in times[:-1]:
        none = s is None or e != e
        clip = None if none else sound[at(s, {"a": 100, "b": 5}[k]) : at(e, {"a": 100, "b": 5}[k])].tolist()
        dropped = "no time" if none else "too short" if len(clip) < 2 else ""
        want.append((k, s, e, dropped, clip if dropped == "" else None))
    assert repr(rows(got)) == repr(sorted(want, key=repr))
    with_hole = MO.audio_blocks(audio, ["k"], size).filter("block <> 2")
    try:
        MO.event_clips(events, with_hole, lengths, ["k"], "s", "e", rate, 0.2, size).collect()
    except Exception as e:
        assert "lacks samples" in str(e)
    else:
        raise AssertionError("a hole in the audio must show")
