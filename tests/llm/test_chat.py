import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgrid.llm import chat

tricky = st.text(alphabet=st.sampled_from(list("\\<|>[]/sINST\n turnedé😀")), max_size=40)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), tricky), tricky), max_size=6))
def test_round_trip(turns):
    formatted, mask = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_paths_of_a_tree(spark):
    # 1 -> 2 -> 4 -> 6, 1 -> 3 -> 5; 9 has a parent that is missing
    rows = [(1, None, 1, 0.0), (2, 1, 1, 0.1), (3, 1, 1, 0.9), (4, 2, 1, 0.1), (5, 3, 1, 0.9), (6, 4, 1, None), (9, 77, 2, 1.0)]
    messages = spark.createDataFrame(rows, "id long, parent long, tree_id long, score double")
    got = {}
    for r in chat.paths(messages, best=2).orderBy("depth").collect():
        got.setdefault((r["tree_id"], r["rank"]), []).append(r["id"])
    assert got == {(1, 1): [1, 3, 5], (1, 2): [1, 2, 4, 6], (2, 1): [9]}


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, None, None, "<|end|>\n"), (None, 3, "assistant", ""), (None, 1, "user", "q")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"t{i} \\") for i in range(70)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.formatted_conversations(df).collect()}
    by = {c: sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c)) for c in {r[0] for r in rows}}
    by[-7] = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.formatted_conversations(df.limit(0)).count() == 1


def test_paths_of_random_trees_match_a_plain_search(spark):
    rng, rows = random.Random(6), []
    for tree in range(25):
        own = []
        for _ in range(rng.randrange(1, 30)):
            parent = rng.choice([None, *own[-4:], *own]) if own else None
            if rng.random() < 0.05:
                parent = -len(rows) - 1  # of a message that is missing
            own.append(len(rows))
            rows.append((len(rows), parent, tree, rng.choice([None, 0.0, 0.25, 0.5, 1.0])))
    parent_of = {i: p for i, p, *_ in rows}
    score = {i: s or 0.0 for i, _, _, s in rows}
    inner, want = {*parent_of.values()}, {}
    for tree in range(25):
        found = []
        for leaf in (i for i, _, t, _ in rows if t == tree and i not in inner):
            path = [leaf]
            while parent_of.get(path[0]) in parent_of:
                path.insert(0, parent_of[path[0]])
            found.append((-sum(score[i] for i in path) / len(path), leaf, path))
        want |= {(tree, k): path for k, (*_, path) in enumerate(sorted(found)[:3], 1)}
    got = {}
    messages = spark.createDataFrame(rows, "id long, parent long, tree_id long, score double")
    for r in chat.paths(messages, best=3).orderBy("depth").collect():
        got.setdefault((r["tree_id"], r["rank"]), []).append(r["id"])
    assert len(want) > 40 and got == want
