"""Exact dedup, conversation repair and fill-in-the-middle against brute force, on odd tables and at forced recursion."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from corpusloom.llm import conversation_repair, exact_dedup, fill_in_middle, queries

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
TEXTS = [
    None, "", " ", "\t\n", "a b", "a  b", "a b", " a b", "a b ", "a\x0b\x0cb", "é 漢 🙂\nx", "<P> marked", "x <M", "one", "two words", "z" * 4000, "long " * 3000, "<" * 9 + " <S P> <", "a\x1cb \x85 c", "same text", "same\ntext",
]


def deduplicated_by_brute_force(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(SPACE.sub(" ", text or ""), []).append(doc_id)
    return sorted(((i, min(g), len(g), i == min(g), sha(t)) for t, g in groups.items() for i in g))


@pytest.mark.parametrize(("table_bytes", "hot"), [(exact_dedup.TABLE_BYTES, exact_dedup.HOT), (4000, 4096), (4000, 2), (20_000, 2)])
def test_exact_dedup_matches_brute_force(spark, table_bytes, hot):
    """A third of all rows are copies of one text; small tables force recursion, low ``hot`` salted shares."""
    rows = list(enumerate(TEXTS + ["hot  text " * 20] * 25 + [f"u {k % 9}" for k in range(20)]))
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = exact_dedup.deduplicate(docs, table_bytes, hot)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == deduplicated_by_brute_force(rows)


def test_exact_dedup_odd_rows(spark):
    schema = "doc_id long, text string, row int, record string, content int, keep_id string, HASH int"
    rows = [(None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 0, "", 0, "", 0) for i, t in rows], schema)
    got = sorted((r.text_sha256, str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs).collect())
    a, b, none = sha("a"), sha("b"), sha("")
    want = [(a, "3", 3, 3, True), (a, "3", 3, 3, False), (a, "None", 3, 3, False), (b, "None", None, 2, True), (b, "None", None, 2, False), (none, "4", 4, 2, True), (none, "5", 4, 2, False)]
    assert got == sorted(want, key=lambda x: x[:2] + (str(x[2]), x[3], x[4]))
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_tables_compare_contents_not_hashes():
    table = exact_dedup.ContentTable(10_000)
    entries = [table.find(7, c) for c in (b"x", b"y", b"x", b"z", b"y")]
    assert entries == [0, 1, 0, 2, 1]
    entries = [table.find(k & 3, b"%d" % k) for k in range(100)]
    assert len(set(entries)) == 100 and [table.find(k & 3, b"%d" % k) for k in range(100)] == entries
    full = exact_dedup.ContentTable(100)
    assert [full.find(1, b"a" * 90), full.find(2, b"b" * 90), full.find(1, b"a" * 90)] == [0, None, 0]


def cheapest(initials, faults):
    """(cost, audit) by trying every edit in every state of the grammar."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(initials) and state in (0, 3) else []
        moves = [(5, "I", i, step[state].get(x), inserted + 1) for x in "ua" if inserted < 2]
        if i < len(initials):
            moves.append((2, "D", i + 1, state, 0))
            if faults[i] not in (1, 2):
                stay = 5 if faults[i] == 3 else 0
                moves += [(stay, "K", i + 1, step[state].get(initials[i]), 0), *((stay + 1, "R", i + 1, step[state].get(x), 0) for x in "ua")]
        for cost, op, j, after, k in moves:
            if after is not None and (rest := best(j, after, k)):
                found.append((cost + rest[0], op + rest[1]))
        return min(found, default=None)

    return best(0, 0, 0)


def repaired_by_brute_force(rows):
    """rows: (conv_id, turn, role, text), already damaged."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        cost, audit = cheapest(tuple(initials), tuple(faults))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        left, result, n = iter(mine), [], sum(op != "D" for op in audit)
        for op in audit:
            row = None if op == "I" else next(left)
            if op != "D":
                role = row[2] if op == "K" else ["user", "assistant"][(n - len(result)) % 2]
                result.append(f"{role}:{row[3] if row else ''}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, sha("\n".join(result))
    return out


def damaged_by_brute_force(rows):
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def conversations():
    pick = random.Random(11)
    rows = []
    for conv in [*range(60), None]:
        rows += [(conv, k, pick.choice(["user", "assistant"]) if pick.random() < 0.3 else ["user", "assistant"][k % 2], f"text {conv} {k}" + pick.choice(["", ".", "!", "? \n"])) for k in range(pick.randrange(1, 9))]
    rows += [(100, k, ["user", "assistant"][k % 2], f"t{k}.") for k in range(150)]  # a third of the rows
    rows += [(101, None, "system", "S."), (101, None, "tool", "x"), (101, 5, None, None), (101, 9, "", "e."), (101, 9, "\U0001f642", "f.")]
    rows += [(102, 1, "user", "twice."), (102, 1, "user", "twice."), (103, 1, "system", "only.")]
    return rows


@pytest.mark.parametrize("block", [conversation_repair.BLOCK, 1, 4])
def test_conversation_repair_matches_brute_force(spark, block):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    damaged = conversation_repair.damaged(table)
    want_rows = list(damaged_by_brute_force(rows))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, damaged.collect()), key=order) == sorted(want_rows, key=order)
    want = repaired_by_brute_force(want_rows)
    empty = 0, 0, 0, 0, 0, 0, "", sha("")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.digests(table, conversation_repair.Repair(damaged, block)).collect()}
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}}


def test_conversation_repair_of_nothing_and_with_other_columns(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi.", "p", 1), (1, 1, "assistant", "Yes.", "p", 2)], "conv_id long, turn long, role string, text string, place string, row int")
    repair = conversation_repair.Repair(table)
    assert [(r.edit, r.role, r.text) for r in repair.turns().orderBy("place").collect()] == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]
    assert conversation_repair.digests(table.limit(0), conversation_repair.Repair(table.limit(0))).count() == 0


def test_blocks_put_together_are_the_whole():
    pick = random.Random(2)
    for _ in range(300):
        n, size = pick.randrange(1, 13), pick.randrange(1, 5)
        initials = ["ua"[i % 2] if pick.random() < 0.6 else pick.choice("suat") for i in range(n)]
        faults = [pick.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        blocks = [conversation_repair.Block(initials[k : k + size], faults[k : k + size]).transfers([0] if not k else [0, 1, 2, 3], k + size >= n and n % 2 == 0) for k in range(0, n, size)]
        assert conversation_repair.put_together(blocks) == cheapest(tuple(initials), tuple(faults))


def test_bands_grow_to_the_cost():
    """So many turns must go that the first band is too narrow on both sides."""
    for initials, faults in (["u"] * 60, [1] * 50 + [0] * 10), (["a"] * 40, [0] * 40), (["u", "t"] * 30, [3, 0] * 30), (["s"] + ["a"] * 50, [0] * 51):
        found = conversation_repair.Block(initials, faults).transfers([0], True)
        assert conversation_repair.put_together([found]) == cheapest(tuple(initials), tuple(faults))


def cut_by_brute_force(doc_id, text):
    text, units = text or "", UNIT.findall(text or "")
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    return (len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h[3] % 100 < 80 else (len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_fill_in_middle_matches_brute_force(spark):
    rows = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS)] + [(None, "no id here"), (7, "a b c"), (7, "a b c")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, N int, other string")
    made = fill_in_middle.transform(docs)
    assert made.columns == ["doc_id", "text", "other", "n", "form", "output", "prefix_chars", "middle_chars"]
    made = made.withColumn("restored", fill_in_middle.restore(made["output"], made["form"])).collect()
    assert {r.form for r in made} == {"plain", "spm", "psm"} and len(made) == len(rows)
    for r in made:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == cut_by_brute_force(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    assert fill_in_middle.transform(docs.limit(0)).count() == 0


def test_long_texts(spark):
    """Millions of units in one match, and contents over a table's size."""
    texts = ["wörd \n\t x" * 400_000, "  " * 1_000_000, "y" * 3_000_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string")
    for r in fill_in_middle.transform(docs).collect():
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == cut_by_brute_force(r.doc_id, r.text)
    got = exact_dedup.deduplicate(docs, table_bytes=1 << 20)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {(k, k % 3, 3) for k in range(9)}
    turns = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant"], [texts[0] + ".", texts[2] + "."]))], "conv_id long, turn long, role string, text string")
    assert conversation_repair.Repair(turns).sums.select("cost", "audit").first() == (0, "KK")


def test_sql_is_given():
    assert {"op11_exact_dedup", "op12_conversation_repair", "op13_fill_in_middle"} <= queries.oracle_sql().keys()
