import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import auction, repair
from tidemark.llm.repair import damaged, repaired, repairs, with_all
from tidemark.operators import history

NAMES = (
    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
    "repaired_sha256",
)
SCHEMA = "conv_id long, turn long, role string, text string, cell int, conv string, cost string"


def cheapest(codes):
    """Cost and edits by dynamic programming over (state, cost, letters)."""
    now = {0: (0, "")}
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(best):
        for _ in range(3):
            for state, (cost, letters) in list(best.items()):
                new = (cost + 3, letters + "I")
                best[after[state]] = min(best.get(after[state], new), new)
        return best

    for code in codes:
        step = {}
        for state, (cost, letters) in inserted(now).items():
            ways = [(state, cost + 4, letters + "D")]
            if code not in "bd":
                more, kind = (3 if code.isupper() else 0), code.lower()
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
                if (kind, state) in kept:
                    ways.append((kept[kind, state], cost + more, letters + "K"))
                ways.append((after[state], cost + 3 + more, letters + "R"))
            for to, *new in ways:
                step[to] = min(step.get(to, tuple(new)), tuple(new))
        now = step
    ends = inserted(now)
    return min(ends[state] for state in (0, 3) if state in ends)


def brute(rows, planted=True):
    ids = {r["conv_id"] for r in rows}
    groups = {}
    for r in rows:
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        times = 1
        if planted:
            conv, turn = (" " if r[c] is None else str(r[c]) for c in ("conv_id", "turn"))
            fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            times = 2 if fault == 3 else 1
            role = "user" if fault == 4 else role
        groups.setdefault(r["conv_id"], []).extend([(r["turn"], role, text)] * times)
    out = []
    for conv_id in ids:
        members = sorted(groups.get(conv_id, []), key=lambda r: (
            r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, codes, illegal = set(), "", 0
        for i, (_, role, text) in enumerate(members):
            tail = text.rstrip(" \t\n\x0b\x0c\r")
            code = role[:1] if role[:1] in tuple("sua") else "x"
            if not tail:
                code = "b"
            elif (role, text) in seen:
                code = "d"
            elif tail[-1] not in ".!?":
                code = code.upper()
            seen.add((role, text))
            codes += code
            illegal += i > 0 and members[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = cheapest(codes)
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter != "I":
                _, role, text = members[at]
                at += 1
            else:
                text = ""
            if letter == "D":
                continue
            if letter in "RI":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        turns = {t for t, _, _ in members if t is not None}
        out.append((
            conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, codes.count("b"),
            codes.count("d"), sum(c.isupper() for c in codes), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r[n] for n in NAMES) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ties, repeated rows, odd roles, blanks, long conversations."""
    rng, rows = random.Random(3), []
    roles = ["user", "assistant", "system", "", None, "tool", "ubuntu", "user", "assistant"]
    texts = ["Yes.", "no", "  \t", "", None, "What?\n", "Größe 🙂!", "cut short,", "a" * 70_000 + "."]
    for conv in [*range(60), None, -5, 10**15]:
        for _ in range(rng.randrange(1, 9)):
            turn = rng.choice([None, 0, 1, 2, 3, 4, 5, 9])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts), 7, "x", "y"))
    for conv, size in ((100, 64), (101, 63), (102, 65), (103, 400), (104, 1_500)):
        for turn in range(size):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"t{turn}." if rng.random() < 0.8 else rng.choice(texts[:-1])
            rows.append((conv, turn, role, text, 7, "x", "y"))
    rows += [rows[5]] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_repairs_equal_those_of_dynamic_programming(odd):
    rows = odd.collect()
    assert got(with_all(odd, repairs(damaged(odd)))) == brute(rows)
    assert got(repairs(odd)) == brute(rows, planted=False)


def test_cut_points_and_small_blocks_change_nothing(odd, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    monkeypatch.setattr(
        repair, "find_cut_points", lambda df, line: history.find_cut_points(df, line, 50)
    )
    assert got(repairs(odd)) == brute(odd.collect(), planted=False)


def test_the_repaired_rows_give_the_hash_and_are_legal(odd):
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in repairs(odd).collect()}
    lines = {}
    for r in repaired(odd).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for conv_id, made in lines.items():
        assert [p for p, _, _ in made] == list(range(len(made)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in made))
        text = "\n".join(f"{r}:{t}" for _, r, t in made)
        assert hashlib.sha256(text.encode()).hexdigest() == hashes[conv_id]


def test_an_empty_table_and_a_conversation_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repairs(damaged(none)).count() == 0
    assert with_all(none, repairs(damaged(none))).count() == 0
    ids = spark.createDataFrame([(5,), (None,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    assert got(with_all(ids, repairs(none))) == sorted(
        [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (5, None)], key=repr)


def test_chained_blocks_give_the_edits_of_the_whole_lattice():
    rng = random.Random(1)
    for _ in range(300):
        codes = "".join(rng.choice("suaxSUAXbduauaua") for _ in range(rng.randrange(1, 14)))
        cost, state, letters = auction.edits(codes, auction.END_COSTS, (0,))[0]
        assert (cost, letters + auction.END_LETTERS[state]) == cheapest(codes)


def test_prices_stay_feasible_and_are_exact_on_the_path():
    lattice = auction.row_lattice("uUaxbduassua" * 5, auction.END_COSTS)
    for origin in range(auction.STATES):
        lattice.auction(origin)
    for node, arcs in enumerate(lattice.arcs):
        for to, cost, _ in arcs:
            assert lattice.price[node] <= cost + lattice.price[to]
    exact = lattice.reaching(tight=True)
    assert all(exact[origin] for origin in range(auction.STATES))
