import random

import pytest
from conftest import rows
from speechloom.llm.components import connected_components
from speechloom.llm.conversations import find_conversations, good_conversations, rebuild_conversations, with_identifiers

ROW = "swda_filename string, ptb_basename string, conversation_no int, transcript_index int, caller string, utterance_index int, subutterance_index int, text string"
META = "conversation_no int, from_caller int, to_caller int"


def frame(spark, data, c=1):
    return spark.createDataFrame([("f", None, c, i, *d) for i, d in enumerate(data, 1)], ROW)


GOOD = [("A", 1, 1, "hi there"), ("A", 1, 2, "so"), ("B", 2, 1, "yes"), ("A", 3, 1, "uh")]
BROKEN = {
    "no index": [*GOOD, ("A", None, 1, "x")], "no sub": [*GOOD, ("A", 3, None, "x")], "utterance hole": [*GOOD, ("A", 5, 1, "x")], "begins at 2": [("A", 2, 1, "a"), ("B", 3, 1, "b")],
    "sub hole": [*GOOD, ("A", 3, 3, "x")], "two speakers": [*GOOD, ("B", 3, 1, "uh")], "two texts": [*GOOD, ("A", 3, 1, "er")], "one side": [("A", 1, 1, "a"), ("B", 2, 1, "uhh /")], "nobody": [("A", 1, 1, None), ("B", 2, 1, "")],
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken(spark, name):
    assert rebuild_conversations(frame(spark, BROKEN[name]), spark.createDataFrame([], META))[1].first().broken


def test_good(spark):
    d = frame(spark, [*GOOD, ("speakerA", 3, 1, "uh")]).unionByName(frame(spark, GOOD)).selectExpr("*", "1 as broken", "2 as n_rows", "3 as word")
    m = spark.createDataFrame([(1, 5, 6)], META)
    assert not rebuild_conversations(d, m)[1].first().broken
    assert [(r.position, r.speaker, r.text) for r in good_conversations(d, m).orderBy("position").collect()] == [(1, "A", "hi there"), (2, "A", "so"), (3, "B", "yes"), (4, "A", "uh")]
    assert good_conversations(d.limit(0), m).count() == 0


def test_many_without_identifier_stay_apart(spark):
    n = 60_000  # with identifiers of 31 bits a pair or two would be one
    d = spark.range(n).selectExpr("concat('f', id) as swda_filename", "cast(null as string) as ptb_basename", "cast(null as int) as conversation_no", "1 as transcript_index", "'A' as caller", "1 as utterance_index", "1 as subutterance_index", "'hi' as text")
    got = with_identifiers(d.unionByName(frame(spark, GOOD)))
    assert got.select("conversation_no").distinct().count() == n + 1 and got.filter("conversation_no >= 0").select("conversation_no").distinct().collect() == [(1,)]


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, x) for x in range(5001, 5100)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    d = spark.createDataFrame([*edges, *edges[:30], (None, 4), (4, None)], "u bigint, v bigint")
    got = {r.node: r.component for r in connected_components(d).collect()}
    want = {x: find(x) for x in {e for u, v in edges if u != v for e in (u, v)}}
    assert got == want
    assert connected_components(d.limit(0)).count() == 0


def test_rows_without_identifiers_join_their_conversation(spark):
    d = spark.createDataFrame([("f", None, 7, 1, "A", 1, 1, "a"), ("f", None, None, 2, "B", 2, 1, "b"), ("f", None, None, 3, "A", 3, 1, "c"), ("g", None, None, 1, "A", 1, 1, "d"), ("g", "p", None, 2, "B", 2, 1, "e"), ("h", "p", None, 1, "A", 1, 1, "z")], ROW)
    got = {(r.swda_filename, r.transcript_index): r.conversation_no for r in with_identifiers(d).collect()}
    assert got["f", 2] == got["f", 3] == 7 and got["g", 1] == got["g", 2] == got["h", 1] < 0
    assert rows(with_identifiers(d.filter("conversation_no is not null")).select("text")) == [("a",)]


def test_find_conversations_in_long_files(spark):
    d = spark.createDataFrame([(i, "f", i, None) for i in range(40)] + [(1000 + i, "g", i, None) for i in range(5)] + [(9, "f", 9, None)] * 0, "node bigint, swda_filename string, transcript_index int, ptb_basename string")
    from speechloom.llm import conversations as C

    links = C.reply_links(d, block=7)
    assert links.count() == 43
    assert {r.component for r in find_conversations(d).collect()} == {0, 1000}
