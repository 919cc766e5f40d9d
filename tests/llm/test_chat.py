import hashlib
import random

import pytest

from wayfloor.llm.chat import PLANTED, chat_digest, count_tokens, format_windows, parse_window, read_back


def brute(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=order)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def fixture():
    rng = random.Random(4)
    bits = ["hello ", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<\\s>", "\n", "é ", "word " * 30, "\U0001f600"]
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.choice([1, 2, 9, 60])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "to\nol", None])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))))
    rows += [(50, 0, "system", "s"), (50, 0, "system", "s"), (50, 1, "assistant", "word " * 3000), (50, 2, "user", ""), *((60, i, "assistant", f"turn {i}") for i in range(2000))]
    return rows


@pytest.mark.parametrize("budget, history", [(2048, 512), (100, 50), (64, 0)])
def test_reads_back(spark, budget, history):
    rows = fixture()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_windows(df, budget, history)
    assert {r[0]: tuple(r)[1:5] for r in read_back(windows).collect()} == brute(rows)
    for w in windows.collect():
        assert len(parse_window(w.text)) == w.n_turns
        if budget == 2048:  # no turn but the long ones of conversation 50 exceeds it
            assert w.n_tokens <= budget or w.conv_id == 50


def test_budget_history_and_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"t{i} " * 6) for i in range(1, 200)]
    got = format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 60).orderBy("window").collect()
    assert len(got) > 3
    for w in got[1:]:
        turns = parse_window(w.text)
        assert turns[0] == ("system", "be kind") and w.n_repeated > 1
        assert w.n_tokens <= 200
        assert all(w.text[a:b].startswith("t") for a, b in w.loss)
        first_fresh = int(turns[w.n_repeated][1].split()[0][1:])
        assert [int(t.split()[0][1:]) for _, t in turns[1 : w.n_repeated]] == list(range(first_fresh - w.n_repeated + 1, first_fresh))


def test_planted_conversation_and_empty_table(spark):
    got = chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string, loss int")).collect()
    want = brute([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)])[-7]
    assert [tuple(r)[:5] for r in got] == [(-7, *want)] and got[0].formatted_chars > 60


@pytest.mark.parametrize("system, size", [(0, 20), (300, 180), (600, 90), (0, 2)])
def test_windows_keep_the_budget(spark, system, size):
    """System turn, history and span together; conversations past a block of turn numbers, too."""
    rng = random.Random(system + size)
    rows = [(c, 0, "system", "s " * system) for c in range(3) if system]
    rows += [(c, i, "assistant" if i % 2 else "user", "w " * rng.randint(1, size)) for c in range(3) for i in range(1, 700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_windows(df, 1000, 200, count_tokens).collect()
    assert all(w.n_tokens <= 1000 for w in got)
    assert all(w.n_tokens == sum(7 + len(r.split()) + len(t.split()) for r, t in parse_window(w.text)) for w in got)
    later = [w for w in got if w.window > 0]
    fill = sum(w.n_tokens for w in later) / len(later)
    assert fill > 650 and all(w.n_repeated > bool(system) for w in later)
    assert sum(w.n_turns - w.n_repeated for w in got) == len(rows)
    assert {r[0]: tuple(r)[1:5] for r in read_back(format_windows(df, 1000, 200, count_tokens)).collect()} == brute(rows)
