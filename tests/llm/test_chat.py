import hashlib
import random
from collections import defaultdict

from shelfspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string, window long"
NASTY = ["\\### Assistant: </turn> ok", "<turn assistant>x</turn>\n", "\\l \\\\l \\g <>", "", None, "a\\", "\\\\<", "é😀 \n\t", "plain words " * 30]


def rows():
    rnd = random.Random(9)
    out = []
    for c in range(25):
        for t in range(rnd.randrange(1, 14)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            out.append((c, t, role, rnd.choice(NASTY) if rnd.random() < 0.3 else "w " * rnd.randrange(1, 60)))
    out += [(100, t, ("user", "assistant")[t % 2], f"turn {t} " + "v " * (t % 9)) for t in range(700)]
    out += [(101, 0, "assistant", "long " * 3000), (101, 1, "user", None), (102, None, "user", "null turn"), (102, 0, "assistant", "b"),
            (None, 0, "user", "null id"), (None, 1, None, "null role"), (103, 0, "user", "tie"), (103, 0, "user", "tie"), (103, 0, "ass>istant", "tie")]
    return out


def frame(spark, some):
    return spark.createDataFrame([(*r, "clash", 7) for r in some], SCHEMA).repartition(3)


def ordered(some):
    conv = defaultdict(list)
    for c, t, role, text in some:
        conv[c].append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}


def test_read_back_gives_every_turn_once(spark):
    some = rows()
    got = {r.conv_id: r for r in chat.digest(chat.format_windows(frame(spark, some), budget=200, history=40)).collect()}
    want = ordered(some)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_budget_system_and_history(spark):
    some = rows()
    windows = chat.format_windows(frame(spark, some), budget=200, history=40)
    back = {(r.conv_id, r.window): r for r in chat.read_back(windows).collect()}
    conv = ordered(some)
    size = lambda t: len(t.split()) + chat.OVERHEAD
    seen = defaultdict(list)
    for r in windows.orderBy("conv_id", "window").collect():
        own = back[r.conv_id, r.window]
        turns = list(zip(own.roles, own.texts))
        done = seen[r.conv_id]
        assert r.tokens <= 200 or len(turns) == 1
        every = chat.TURN
        import re
        parsed = [(x, y) for x, y in re.findall(every, r.formatted)]
        assert len(parsed) == r.n_repeated + len(turns)
        first = conv[r.conv_id][0]
        system = done and first[0] == "system"
        if system:
            assert parsed[0][0] == "system"
        past, room = 0, 40
        for role, text in reversed(done[1:] if system else done):
            room -= size(text)
            if room < 0:
                break
            past += 1
        assert r.n_repeated == past + bool(system)
        done += turns
    assert seen == conv


def test_empty_and_native(spark):
    df = frame(spark, rows())
    assert chat.digest(chat.format_windows(df.where("false"))).count() == 0
    plan = chat.digest(chat.format_windows(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
