import hashlib
import random

import duckdb
import pytest

from tidemark.llm.chat_format import format_chats, op6_chat_format, read_back


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def wanted(rows):
    out = {}
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = len(turns), digest(said), len(loss), digest(loss)
    return out


def got(windows):
    back = {}
    for w in sorted(read_back(windows).collect(), key=lambda w: (str(w["conv_id"]), w["window"])):
        n, said, loss = back.get(w["conv_id"], (0, "", ""))
        back[w["conv_id"]] = n + len(w["turns"]), said + "".join(f"{t['role']}\n{t['text']}\n" for t in w["turns"]), loss + "".join(w["loss_texts"])
    return {c: (n, digest(s), len(x), digest(x)) for c, (n, s, x) in back.items()}


ODD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "\\</s>\\", "\\\\", "<<SYS>> a <</SYS>>", "<\\s>", "", None, "é" * 700, "x\ny", "[\\INST]", "<|im_again|>"]


@pytest.mark.parametrize("budget,history", [(512, 96), (40, 12), (64, 0)])
def test_round_trip(spark, budget, history):
    rng = random.Random(budget)
    rows = []
    for c in range(40):
        n = rng.randrange(1, 12)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "a b\n|", None])
            rows.append((c, t if c % 5 else 0, role, rng.choice(ODD + ["w" * rng.randrange(200)])))
    rows += [(None, 1, "assistant", "n"), (None, None, "user", "m"), (77, 0, "system", "only"), (78, 5, "assistant", "same"), (78, 5, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "'x' as formatted")
    windows = format_chats(df, budget, history).cache()
    assert got(windows) == wanted(rows)
    size = {tuple(r)[:2]: r["n_tokens"] for r in windows.select("conv_id", "window", "n_tokens").collect()}
    assert len(size) == windows.count()


def test_budget_and_history(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, t, "user" if t % 2 else "assistant", "w" * 60) for t in range(1, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_chats(df, 128, 48).orderBy("window").collect()
    assert len(windows) > 5
    for i, w in enumerate(windows):
        assert w["n_tokens"] <= 128
        assert w["formatted"].startswith("<|im_start|>system" if i == 0 else "<|im_again|>system")
        assert (w["formatted"].count("<|im_again|>") > 1) == (i > 0)


def test_windows_are_full_and_long_turns_are_told(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "w" * 76) for t in range(2000)] + [(2, t, "user", "w" * (9000 if t == 7 else 40)) for t in range(30)]
    windows = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    full = [w["n_tokens"] for w in windows if w["conv_id"] == 1]
    assert max(full) <= 512 and sum(full) / len(full) > 0.85 * 512
    assert [w["n_tokens"] > 2000 for w in windows if w["over_budget"]] == [True]


MIXES = {"small": lambda i: 100, "spread": lambda i: 40 + i * 7919 % 1160, "two sizes": lambda i: 60 if i % 3 else 700, "pairs": lambda i: 760 + 200 * (i % 2)}


def greedy(tokens, room, history):
    """Windows of turns as (first, last, repeated turns before the first)."""
    out, i = [], 0
    while i < len(tokens):
        back = 0
        if out:
            a = out[-1][0]
            while i - back - 1 >= a and sum(tokens[i - back - 1 : i]) <= history:
                back += 1
            if sum(tokens[i - back : i + 1]) > room:
                back = 0
        j = i
        while j + 1 < len(tokens) and sum(tokens[i - back : j + 2]) <= room:
            j += 1
        out.append((i, j, back))
        i = j + 1
    return out


def test_windows_of_mixed_turns_are_as_full_as_turns_allow(spark):
    rows = [(name, t, "user" if t % 2 else "assistant", "w" * size(t)) for name, size in MIXES.items() for t in range(600)]
    rows += [(f"s{name}", t, "system" if t == 0 else "user", "w" * (300 if t == 0 else size(t))) for name, size in MIXES.items() for t in range(300)]
    windows = format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    for name in {r[0] for r in rows}:
        own = sorted((w for w in windows if w["conv_id"] == name), key=lambda w: w["window"])
        tokens = [-(-len(x) // 4) + 4 for c, _, _, x in rows if c == name]
        cost = tokens.pop(0) if name[0] == "s" and name[1:] in MIXES else 0
        want = greedy(tokens, 512 - cost, 96)
        assert [w["n_tokens"] for w in own] == [cost + sum(tokens[a - back : b + 1]) for a, b, back in want], name
        assert not any(w["over_budget"] for w in own)
    fill = lambda name: sum(w["n_tokens"] for w in windows if w["conv_id"] == name) / 512 / sum(w["conv_id"] == name for w in windows)
    assert all(fill(name) > (0.7 if name == "spread" else 0.85) for name in MIXES), {name: fill(name) for name in MIXES}


def test_odd_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(df).count() == 0 and format_chats(df.limit(0)).columns[:3] == ["conv_id", "window", "formatted"]
    rows = [(1, 1024 * b + t, "user", "w" * 100) for b in range(3) for t in range(5)]  # blocks of turn numbers
    found = format_chats(spark.createDataFrame(rows, df.schema))
    assert got(found)[1][0] == 15 and found.where("over_budget").count() == 0


def test_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    found = op6_chat_format(spark, sf)
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found.collect()} == wanted(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
