import json

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def varied(rng, words, share):
    """Changes one word in each of as many places as lowers the similarity of five-word shingles to the share."""
    out = list(words)
    changes = max(1, round(len(words) * (1 - share) / (1 + share) / 5))
    for at in np.linspace(3, len(words) - 4, changes).astype(int):
        out[at] = f"edit{rng.integers(1 << 40)}"
    return out


def test_near_copies_leave_one_of_each_group(spark):
    from bandweave.llm.simhash import drop_near_copies

    rng = np.random.default_rng(2)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    sources = [list(rng.choice(vocabulary, 300)) for _ in range(40)]
    rows, group = [], {}
    for g, words in enumerate(sources):
        for share in (1.0, 0.95, 0.9, 0.85):
            i = len(rows)
            rows.append((i, " ".join(words if share == 1.0 else varied(rng, words, share)), "s"))
            group[i] = g
    big = list(rng.choice(vocabulary, 400))
    for k in range(120):  # one large group around a source
        i = len(rows)
        rows.append((i, " ".join(big if k == 0 else varied(rng, big, 0.9)), "s"))
        group[i] = -1
    half = [*sources[0][:150], *rng.choice(vocabulary, 150)]  # shares a third of its shingles: stays
    rows += [(9000, " ".join(half), "s"), (9001, None, "s"), (9002, "", None), (9003, "one", "s"), (None, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _KEY string")
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    assert {9000, 9001, 9003} <= set(kept) and 9002 not in kept and None not in kept
    of = {}
    for i in kept:
        if i in group:
            of.setdefault(group[i], []).append(i)
    assert set(of) == set(group.values())
    assert all(min(v) == min(i for i in group if group[i] == g) for g, v in of.items())
    assert sum(len(v) for v in of.values()) <= len(of) + 2  # all but a few of the copies are gone
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_wide_fingerprints_estimate_similarity():
    from bandweave.llm.simhash import differing_share, shingle_hashes, wide_of

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 5000, 600)]
    base = wide_of(shingle_hashes(" ".join(words), 5), 20)
    for share in (0.95, 0.8, 0.6):
        other = varied(rng, words, share)
        j = jaccard(shingles(" ".join(words)), shingles(" ".join(other)))
        found = wide_of(shingle_hashes(" ".join(other), 5), 20)
        assert abs(np.bitwise_count(base ^ found).sum() / 1280 - differing_share(j)) < 0.03


def test_shingle_hashes_stand_for_shingles():
    """As many hashes as distinct shingles, the same wherever a shingle stands; words of any length and bytes."""
    from bandweave.llm.simhash import shingle_hashes, wide_of

    rng = np.random.default_rng(6)
    words = ["a", "b", "A", "ab", "éa", "x" * 8, "x" * 9, "x" * 63, "x" * 64, "x" * 65, "y" * 500, "\0", "\0\0", "\x1c"]
    for n in (0, 1, 3, 5, 6, 40, 300):
        chosen = [words[i] for i in rng.integers(0, len(words), n)]
        low = [w.translate({c: c + 32 for c in range(65, 91)}) for w in chosen]
        want = {tuple(low[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
        text = " \t" + " \n".join(chosen) + "\x0b"
        hashes = shingle_hashes(text, 5)
        assert len(hashes) == len(want) and (np.diff(hashes.astype(object)) > 0).all()
        assert set(shingle_hashes("q " * 9 + text, 5).tolist()) >= (set(hashes.tolist()) if n >= 5 else set())
    bits = [sum(int(x) >> b & 1 for x in hashes) for b in range(64)]
    assert abs(np.mean(bits) / len(hashes) - 0.5) < 0.05
    assert wide_of(hashes[:0], 20).tolist() == [0] * 20


def test_sets_are_compared_as_blocks():
    from bandweave.llm.simhash import alike_sets, prefix_of

    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 60, int(n)).astype(np.uint64)) for n in rng.integers(0, 50, 40)]
    sets += [np.unique(np.r_[x, np.uint64(99)]) for x in sets]
    want = np.array([[len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9 and len(np.union1d(x, y)) > 0 for y in sets] for x in sets])
    assert (alike_sets(sets, sets, 0.8) == want).all()
    assert (np.block([[alike_sets([x], [y], 0.8) for y in sets] for x in sets]) == want).all()
    for i, j in zip(*np.nonzero(want), strict=True):
        assert len(np.intersect1d(prefix_of(sets[i], 0.8), prefix_of(sets[j], 0.8)))


def test_pipeline_stages_hold(spark):
    import corpus_pipeline as cp
    from bandweave.llm.common import materialize

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, path))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["quality classifier"]
    gone = ids(before) - ids(after)
    clean = [i for i, r in labels.items() if r["quality"] == 1]
    assert sum(i in gone for i in clean) <= 0.05 * len(clean)
    before, after = seen["toxicity"]
    gone = ids(before) - ids(after)
    clean = [i for i in ids(before) if i in labels and labels[i]["toxic"] == 0]
    assert sum(i in gone for i in clean) <= 0.05 * len(clean)
    before, after = seen["exact dedup"]
    texts = ["".join((r["text"] or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}) for r in after.collect()]
    whole = {"".join((r["text"] or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}) for r in before.collect()}
    assert len(texts) == len(set(texts)) and set(texts) == whole
    before, after = seen["SimHash near-dedup"]
    kept = {r["doc_id"]: shingles(r["text"]) for r in after.collect()}
    every = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    pairs = [(a, b) for a in kept for b in kept if a < b and jaccard(kept[a], kept[b]) >= 0.85]
    assert not pairs
    for i in set(every) - set(kept):
        assert max(jaccard(every[i], every[j]) for j in every if j != i) >= 0.7
    before, after = seen["packing"]
    assert ids(after) == ids(before)
    run = cp.run(spark, path)
    assert run.agg(F.sum("length")).first()[0] == after.agg(F.sum("length")).first()[0]


def test_pipeline_takes_odd_tables(spark, tmp_path):
    """Nulls, repeats, clashing names and an empty table go through all stages."""
    import corpus_pipeline as cp
    from bandweave.llm.common import materialize

    names = ["quality_score", "quality_predicted", "toxicity", "kept", "keep_id", "group_size", "text_sha256", "_tag", "_key", "_sketch", "_digest", "score", "judged"]
    good = [(i, f"plain and sound words number {i} come here in order and stay so " * 4) for i in range(40)]
    bad = [(100 + i, f"## {i} @@ $$ %% " * 9) for i in range(20)]
    toxic = [(200 + i, f"words number {i} and more of them. you stupid clown {i}") for i in range(20)]
    odd = [(None, good[1][1]), (None, None), (300, None), (301, ""), (2, good[2][1]), (2, good[2][1]), (302, "word " * 30_000), (303, good[3][1] + "x")]
    rows = [(i, t, *[f"own{k}" for k in range(len(names))]) for i, t in good + bad + toxic + odd]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels = [(i, int(i < 100 or i >= 200), int(i >= 200)) for i, _ in good + bad + toxic]
    for part in "ab":
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{part}/labels.parquet")
    seen = {}
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, f"{tmp_path}/a"))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", *names]
            assert all(tuple(r)[2:] == rows[0][2:] for r in docs.collect())
    left = [r["doc_id"] for r in seen["SimHash near-dedup"].collect()]
    assert len(set(left) & set(range(40))) >= 34 and len(set(left) & {*range(100, 120), *range(200, 220)}) <= 2
    assert left.count(2) == 1
    assert seen["packing"].select("doc_id").distinct().count() == len(set(left))
    assert cp.run(spark, f"{tmp_path}/b").count() == 0


def calls_of(spark, rows):
    return spark.createDataFrame(rows, "conversation long, position long, call_id string, tool string, arguments string, needs array<string>")


def test_tool_calls_are_linked_ordered_and_validated(spark):
    from bandweave.llm.tool_calls import link

    good = '{"turn": 1, "text": "é \\"q\\"\\n"}'
    calls = calls_of(
        spark,
        [
            (1, 0, "a", "answer", good, []),
            (1, 1, "b", "answer", '{"text": 5, "turn": 1.5, "more": {"z": 1, "a": [2, 1]}}', ["a"]),
            (1, 2, None, "answer", good, ["a", None]),
            (1, 3, "d", "nothing", "{}", None),
            (2, 0, "e", "answer", "no json", ["f"]),  # needs a later call
            (2, 1, "f", "answer", "[1]", []),
            (2, 2, "g", "answer", None, ["e", "missing"]),
            (3, 0, "h", "answer", good, ["i"]),  # a cycle
            (3, 1, "i", "answer", good, ["h"]),
            (4, 0, "a2", "setup", '{"text": "x", "turn": 2}', ["a"]),
            (4, 1, "a2", "setup", '{"text": "x", "turn": 2}', []),
        ],
    )
    results = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("f", None, None), ("z", 1, "orphan"), (None, 1, "lost"), ("a2", 1, "")], "call_id string, position long, content string")
    rows = link(calls, results).collect()
    by = {(r["call_id"], r["position"]): r for r in rows}
    assert len(rows) == 12
    assert by["a", 0]["json"] == json.dumps({"arguments": {"text": 'é "q"\n', "turn": 1}, "id": "a", "name": "answer", "result": "first"}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert by["a", 0]["n_results"] == 2 and by["a", 0]["valid"] and by["a", 0]["level"] == 0
    assert by["b", 1]["errors"] == "text is no string; turn is no integer; unknown more"
    assert json.loads(by["b", 1]["json"])["arguments"]["more"] == {"a": [2, 1], "z": 1} and '{"a":[2,1],"z":1}' in by["b", 1]["json"]
    assert by[None, 2]["status"] == "unanswered" and by["d", 3]["errors"] == "unknown tool"
    assert [by[k]["level"] for k in (("f", 1), ("e", 0), ("g", 2))] == [0, 1, 2]
    assert [by[k]["level"] for k in (("b", 1), (None, 2), ("d", 3), ("a2", 0), ("a2", 1))] == [1, 1, 0, 1, 1]
    assert by["h", 0]["level"] is None and by["i", 1]["level"] is None
    assert by["e", 0]["errors"] == by["f", 1]["errors"] == by["g", 2]["errors"] == "arguments are no object"
    assert '"arguments":null' in by["e", 0]["json"] and '"result":null' in by["f", 1]["json"]
    assert by["z", None]["status"] == "orphan" and by["z", None]["level"] is None
    assert by["a2", 0]["status"] == by["a2", 1]["status"] == "linked" and by["a2", 0]["json"].endswith('"result":""}')
    assert link(calls.limit(0), results.limit(0)).count() == 0
    clash = ("level", "_node", "content", "n_results", "STATUS", "json")
    with_more = [x.withColumns({c: F.lit("own") for c in clash if c not in x.columns}) for x in (calls, results)]
    assert sorted(map(str, link(*with_more).collect())) == sorted(map(str, rows))


def test_arguments_keep_to_limits(spark):
    from bandweave.llm.tool_calls import link

    schema = {"t": {"n": ("integer", True, {"minimum": 2, "maximum": 5}), "s": ("string", False, {"maxLength": 3, "enum": ["ab", "éàüx"]})}}
    texts = ['{"n": 2}', '{"n": 1, "s": "ab"}', '{"n": 6, "s": "abc"}', '{"n": 5, "s": "éàüx"}', '{"n": "5", "s": 1}', '{"s": "' + "x" * 50_000 + '"}']
    calls = calls_of(spark, [(1, i, str(i), "t", t, []) for i, t in enumerate(texts)])
    results = spark.createDataFrame([], "call_id string, position long, content string")
    got = [r["errors"] for r in link(calls, results, schema).orderBy("position").collect()]
    assert got == ["", "n is under 2", "n is over 5; s is none of ab, éàüx", "s is longer than 3", "n is no integer; s is no string", "missing n; s is longer than 3"]


def test_levels_are_longest_paths(spark):
    from bandweave.llm.tool_calls import dependency_levels

    rng = np.random.default_rng(3)
    needs = {i: sorted({int(x) for x in rng.integers(0, 60, 3) if x < i}) for i in range(60)}  # any order of identifiers
    names = {i: f"x{k}" for i, k in enumerate(rng.permutation(60))}
    level = {}
    for i in range(60):
        level[i] = 1 + max((level[j] for j in needs[i]), default=-1)
    calls = spark.createDataFrame([(names[i],) for i in range(60)], "call_id string")
    edges = spark.createDataFrame([(names[i], names[j]) for i in needs for j in needs[i]] + [("x1", "gone")], "call_id string, needs string")
    assert {r["call_id"]: r["level"] for r in dependency_levels(calls, edges).collect()} == {names[i]: level[i] for i in level}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def edited(words, places, tag):
    """The words with each of those places replaced: up to five shingles change for each."""
    out = list(words)
    for at in places:
        out[at] = f"{tag}{at}"
    return out


def test_near_copies_are_found_among_strangers(spark):
    """Texts that share most of a template, in chains of close bits; each has one true copy that must go."""
    from bandweave.llm.simhash import drop_near_copies

    rng = np.random.default_rng(8)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(250):
        own = [*template[:235], *(f"k{k}w{i}" for i in range(65))]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edited(own, rng.choice(300, 3, replace=False), f"e{k}x")))]
    sets = {i: shingles(t) for i, t in rows}
    assert 0.6 < jaccard(sets[0], sets[2]) < 0.7 and all(jaccard(sets[2 * k], sets[2 * k + 1]) > 0.88 for k in range(250))
    kept = sorted(r["doc_id"] for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [2 * k for k in range(250)]


def test_near_copies_are_cut_at_the_similarity_itself(spark):
    """Pairs a little above and a little below 0.8; those above lose one, those below none."""
    from bandweave.llm.simhash import drop_near_copies

    rows, above = [], 0
    for k in range(120):
        own = [f"k{k}w{i}" for i in range(304)]
        places = range(5, 5 + 6 * (6 if k % 2 else 7), 6)  # 30 or 35 of 300 shingles: 0.82 or 0.79
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edited(own, places, f"e{k}x")))]
        similar = jaccard(shingles(rows[-2][1]), shingles(rows[-1][1])) >= 0.8
        assert similar == (k % 2 == 1)
        above += similar
    kept = {r["doc_id"] for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert above == 60
    assert kept == {i for i, _ in rows} - {2 * k + 1 for k in range(1, 120, 2)}


def test_fingerprints_leave_similar_small_sets_open():
    from bandweave.llm.simhash import alike_prints, alike_sets, wide_of

    rng = np.random.default_rng(10)
    sets = []
    for n in [4, 5, 6, 8, 9, 12, 20, 40, 63, 80] * 12:
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [one, one[1:], one[n // 5 :]]
    prints = [(len(x), wide_of(x, 20).astype("<u8").tobytes()) for x in sets]
    same, open_ = alike_sets(sets, sets, 0.8), alike_prints(prints, prints, 0.8, 1280)
    assert open_[same].all() and open_.sum() < 1.3 * same.sum()


def test_repeated_lines_do_not_make_near_copies(spark):
    from bandweave.llm.simhash import drop_near_copies

    line = " ".join(f"line{i}" for i in range(10))
    own = [" ".join(f"own{k}w{i}" for i in range(600 if k > 1 else 200)) for k in range(3)]
    rows = [(0, f"{own[0]} " + f"{line} " * 20), (1, f"{own[1]} " + f"{line} " * 20), (2, f"{own[2]} {line}"), (3, f"{own[2]} " + f"{line} " * 20)]
    assert jaccard(shingles(rows[0][1]), shingles(rows[1][1])) < 0.1 and jaccard(shingles(rows[2][1]), shingles(rows[3][1])) > 0.95
    kept = sorted(r["doc_id"] for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [0, 1, 2]


def test_levels_beyond_the_rounds_are_an_error(spark):
    from bandweave.llm.tool_calls import dependency_levels

    calls = spark.createDataFrame([("a",), ("b",), ("c",)], "call_id string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b")], "call_id string, needs string")
    assert {r["call_id"]: r["level"] for r in dependency_levels(calls, needs, max_rounds=3).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(RuntimeError):
        dependency_levels(calls, needs, max_rounds=2)


@pytest.mark.parametrize("width", [(1 << 62, 40, 3), (1 << 62, 56, 5)])
def test_wider_parts_for_more_rows_find_the_same(spark, monkeypatch, width):
    from bandweave.llm import simhash

    monkeypatch.setattr(simhash, "WIDTHS", (width,))
    rows = []
    for k in range(20):
        own = [f"k{k}w{i}" for i in range(304)]
        places = range(5, 5 + 6 * (5 if k % 2 else 8), 6)  # 0.85 or 0.76
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edited(own, places, f"e{k}x")))]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - {2 * k + 1 for k in range(1, 20, 2)}


def test_every_two_members_of_a_key_are_compared(spark):
    """In chunks of 16: groups far from one another, and many members that are like none."""
    from bandweave.llm.common import Scratch
    from bandweave.llm.simhash import alike_sets, linked

    rng = np.random.default_rng(13)
    centres = [rng.integers(0, 1 << 62, 60) for _ in range(4)]
    sets = []
    for k in range(150):
        one = centres[k % 4].copy()
        one[rng.choice(60, 2 if k % 3 else 40, replace=False)] = rng.integers(0, 1 << 62, 2 if k % 3 else 40)
        sets.append(np.unique(one.astype(np.uint64)))
    same = alike_sets(sets, sets, 0.8)
    want, seen = {}, set()
    for i in range(150):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(same[todo.pop()]).tolist():
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            want |= {j: i for j in group} if len(group) > 1 else {}
    members = spark.createDataFrame([(key, i, 1) for key in (1, 2) for i in range(150) if key == 1 or i % 2], "key long, n long, weight long")
    items = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "n long, hashes binary")
    with Scratch(spark) as scratch:
        roots = linked(members, items, lambda h: np.frombuffer(h, np.uint64), lambda a, b: alike_sets(a, b, 0.8), scratch, chunk=16)
        got = {r["node"]: r["root"] for r in roots.collect()}
    assert len(set(want.values())) >= 4 and len(want) < 150
    assert got == want


def test_members_travel_to_their_blocks_in_packs(spark, monkeypatch):
    """A key of three chunks whose members are like none but one pair: few rows are dealt, and the pair is found."""
    from bandweave.llm import simhash
    from bandweave.llm.common import Scratch

    dealt, compared = [], simhash._compared

    def counted(rows, *rest):
        dealt.append(rows.count())
        return compared(rows, *rest)

    monkeypatch.setattr(simhash, "_compared", counted)
    members = spark.range(2600).selectExpr("1L AS key", "id AS n", "1L AS weight")
    items = spark.range(2600).selectExpr("id AS n", "if(id = 2599, 7, id) AS value")
    with Scratch(spark) as scratch:
        roots = simhash.linked(members, items, lambda v: v, lambda a, b: np.equal.outer(np.array(a), np.array(b)), scratch)
        assert {r["node"]: r["root"] for r in roots.collect()} == {7: 7, 2599: 7}
    assert len(dealt) == 2 and max(dealt) < 2600 / 8


def test_members_of_many_keys_are_tied_a_few_times(spark, monkeypatch):
    """200 copies that meet in 40 keys, with strangers and bridges: rows of ties stay near the members, and all links are found."""
    from bandweave.llm import simhash
    from bandweave.llm.common import Scratch

    made, compared = [], simhash._compared

    def counted(*given):
        out = compared(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_compared", counted)
    # n below 200 have the value 0; 200 to 239 are alone in the key of their number with copies, 240 to 279 like these
    rows = [(k, n) for k in range(40) for n in [*range(200), 200 + k, 240 + (k + 1) % 40]]
    rows += [(100 + k, n) for k in range(40) for n in (200 + k, 240 + k)]
    members = spark.createDataFrame(rows, "key long, n long").selectExpr("key", "n", "1L AS weight")
    items = spark.range(280).selectExpr("id AS n", "if(id < 200, 0, if(id < 240, id, id - 40)) AS value")
    want = {n: 0 for n in range(200)} | {n + d: n for n in range(200, 240) for d in (0, 40)}
    for shares in (1, simhash.SHARES):
        made.clear()
        with Scratch(spark) as scratch:
            roots = simhash.linked(members, items, lambda v: v, lambda a, b: np.equal.outer(np.array(a), np.array(b)), scratch, shares=shares)
            assert {r["node"]: r["root"] for r in roots.collect()} == want
    assert sum(made) < 40 * 200 / 3


def test_near_copies_are_compared_in_few_keys(spark, monkeypatch):
    """A group of 150 near copies, which meet in most parts, with strangers: rows to compare stay near the members."""
    from bandweave.llm import simhash

    rng, rows, linked = np.random.default_rng(17), [], simhash.linked
    source = [f"w{i}" for i in rng.integers(0, 3000, 300)]
    texts = [" ".join(source), *(" ".join(varied(rng, source, 0.9)) for _ in range(149)), *(" ".join(f"s{i}x{j}" for j in range(300)) for i in range(20))]

    def counted(members, *rest, **more):
        rows.append(members.count())
        return linked(members, *rest, **more)

    monkeypatch.setattr(simhash, "linked", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == {0, *range(150, 170)}
    assert rows[0] < 5 * 150


@pytest.mark.parametrize("small", [0, 64])
def test_fewer_keys_keep_every_pair(spark, small):
    """Any two members of a key share one afterwards; beyond small members there are no more pairs than before."""
    from bandweave.llm.common import Scratch
    from bandweave.llm.simhash import fewer_keys

    rng = np.random.default_rng(19)
    sets = {}
    for k in range(300):
        members = rng.choice(60 if k % 3 else 3000, rng.integers(2, 50 if k % 3 else 6), replace=False) + (0 if k % 3 else 100)
        sets.setdefault(int(min(members)), set()).update(members.tolist())
    sets |= {5000 + k: {5000 + k, *range(6000 + 90 * k, 6090 + 90 * k)} for k in range(1, 4)} | {5000: {5000, 5001, 5002, 5003}}
    given = spark.createDataFrame([(k, int(n)) for k, v in sets.items() for n in v], "key long, n long")
    with Scratch(spark) as scratch:
        got = [(r["key"], r["n"]) for r in fewer_keys(scratch.table(given), scratch, small).collect()]
    found = {}
    for k, n in got:
        found.setdefault(k, set()).add(n)
    assert len(got) == len(set(got)) <= sum(map(len, sets.values()))
    assert all(any(v <= w for w in found.values()) for v in sets.values())
    assert len(found) < len(sets) and {5001, 5002, 5003} <= set(found)
    assert small or sum(len(v) ** 2 for v in found.values()) <= sum(len(v) ** 2 for v in sets.values())
