"""Conversation repair against a plain dynamic program over all states."""

import hashlib
import random
import zlib

import pytest

from threadlens.llm import conversation_repair as repair
from threadlens.llm.queries import damaged_conversations

SPACE = " \t\n\x0b\x0c\r"


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _expected(rows):
    """Reports by conversation, from the rows after damage."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        name = {"u": "user", "a": "assistant"}
        best = {"": (0, "", ())}

        def relax(states):
            for _ in range(4):
                for state in list(states):
                    cost, audit, lines = states[state]
                    for nxt in step[state]:
                        if nxt != "s":
                            new = (cost + 3, audit + "I", (*lines, f"{name[nxt]}:"))
                            states[nxt] = min(states.get(nxt, new), new)
            return states

        for (_, role, text), fault in zip(own, faults):
            nxt = {}
            for state, (cost, audit, lines) in relax(best).items():
                options = [(state, cost + 4, "D", lines)]
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    if role[:1] in step[state]:
                        options.append((role[:1], cost + more, "K", (*lines, f"{role}:{text}")))
                    options += [(to, cost + 3 + more, "R", (*lines, f"{name[to]}:{text}")) for to in step[state] if to != "s"]
                for to, c, letter, made in options:
                    new = (c, audit + letter, made)
                    nxt[to] = min(nxt.get(to, new), new)
            best = nxt
        cost, audit, lines = min(v for k, v in relax(best).items() if k in ("", "a"))
        known = [t for t, *_ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def _random_rows(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Fine.", "Cut off", " \t", None, f"Own {conv} {turn}!", f"own {conv} {turn}", "é 日本?  \n"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def _check(spark, rows):
    got = repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == _expected(rows) and len({r.conv_id for r in got}) == len(got)


def test_short_conversations(spark):
    rows = _random_rows(1, 300, 9) + [(None, 1, "user", "No id."), (None, 2, "assistant", "Nor here.")]
    _check(spark, rows + rows[:40])


def test_damage(spark):
    rows = _random_rows(2, 200, 8) + [(None, None, "user", "a!"), (7, None, None, None)]
    df = damaged_conversations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, _damage(rows)))


def test_long_conversations(spark, monkeypatch):
    """The distributed path in several levels gives what the local one gives; so does a null id."""
    rows = [r for r in _random_rows(3, 12, 60)]
    rows += [(None, t, random.Random(t).choice(["user", "assistant", "x"]), f"t{t}" + "." * (t % 3)) for t in range(90)]
    monkeypatch.setattr(repair, "CHUNK", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    _check(spark, rows)


def test_one_hot_conversation(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"line {t}" + rng.choice([".", "", "?"])) for t in range(700)]
    rows += [(c, 0, "user", "Hi.") for c in range(2, 400)]
    _check(spark, rows)


def test_turns(spark, monkeypatch):
    rows = _random_rows(6, 30, 12)
    expected = {c: v[-1] for c, v in _expected(rows).items()}
    for chunk in (repair.CHUNK, 3):
        monkeypatch.setattr(repair, "CHUNK", chunk)
        found = {}
        for r in repair.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "pos").collect():
            assert r.pos == len(found.setdefault(r.conv_id, []))
            found[r.conv_id].append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(found.get(c, [])).encode()).hexdigest() for c in expected} == expected


def test_long_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "end."), (1, 1, "assistant", "Yes."), (2, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in repair.repair(df.selectExpr("*", "1 key", "2 seq", "'x' code", "'y' audit")).collect()}
    assert (got[1].audit, got[1].cost) == ("KK", 0) and got[2].audit == "D"
    assert repair.repair(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 17, 128])
def test_auction_of_a_chunk_equals_its_blocks(n):
    """Pricing a chunk as a whole equals pricing its halves and the lattice over them."""
    rng = random.Random(n)
    codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(n))
    parts = [repair._priced_chunk(codes[: n // 2], False), repair._priced_chunk(codes[n // 2 :], True)]
    whole = repair._priced_chunk(codes, True)
    assert repair.between([repair.chain(parts, repair._only(t)) for t in range(4)]) == whole
    assert min(whole[0], whole[3]) == repair.solve(codes)[0]
