"""The trie against dictionaries of prefixes, with shards so small that most nodes lie on borders."""

import hashlib
import random
import zlib

import pytest

from tremor.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string"


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, len(seq)))
    out = set()
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        kids = lambda p: sum(1 for x in nodes if len(x) == len(p) + 1 and x[:-1] == p)
        ends = ",".join(map(str, sorted(c for c, n in members if n == len(node))))
        out.add((min(members)[0], len(node), min(nodes[node[:-1]])[0] if node else None, len(members), kids(node), sum(not kids(x) for x in below),
                 sum((len(nodes[x]) - 1) * len(x[-1][1].split()) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows, **sizes):
    found = [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), **sizes).collect()]
    assert len(found) == len(set(found))
    return set(found)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(4 * n), n):
        if rng.random() < 0.3:
            turns = [("user", "the hot first turn"), ("assistant", "copied answer here"), ("user", "end")][: rng.randint(1, 3)]
        else:
            turns = [(rng.choice(["user", None, ""]), rng.choice(["a", "b c", None, "", "d  e\tf"])) for _ in range(rng.randint(1, 7))]
        rows += [(c, k if k or rng.random() < 0.5 else None, role, text, "x") for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shard,task", [(1, 1, 10), (2, 7, 20), (3, 7, 1000), (4, 1 << 16, 1 << 17)])
def test_like_brute_force(spark, seed, shard, task):
    rows = conversations(seed, 60)
    assert run(spark, rows, shard_turns=shard, task_turns=task) == brute(rows)


def test_many_copies_and_a_long_conversation(spark):
    rows = [(c, k, "user", f"t{k} x", "") for c in range(0, 4000, 20) for k in range(3)] + [(7, k, "user", "long " * (k % 3), "") for k in range(300)]
    assert run(spark, rows, shard_turns=40, task_turns=100) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, 1, "user", "lost", "")]) == set()
    # a conversation whose base is absent and whose own turns are all replaced is turnless, but a member of the root
    short = next(c for c in range(21, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 1, None, None, ""), (short + 1, 1, None, None, ""), (5, None, None, "a b" * 5000, ""), (5, None, "z", None, "")]
    assert run(spark, rows) == brute(rows)
