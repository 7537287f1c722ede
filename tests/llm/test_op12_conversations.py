import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from hearthstat.llm.op12_conversations import Repair, op12_conversation_repair, repair_conversations

SOLID = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All edits of short conversations, at most two insertions before each row and at the end."""
    best = None
    gaps = [list(itertools.product(("user", "assistant"), repeat=n)) for n in range(3)]
    gaps = gaps[0] + gaps[1] + gaps[2]
    choices = []
    for (role, text), fault in zip(rows, found):
        more = 3 * (fault == "truncated")
        own = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            own += [(more, "K", (role, text))] + [(3 + more, "R", (new, text)) for new in ("user", "assistant")]
        choices.append(own)
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = sum(e[0] for e in edits) + 3 * sum(map(len, inserted)), "", []
            if best and cost > best[0]:
                continue
            for i in range(len(rows) + 1):
                audit += "I" * len(inserted[i])
                out += [(role, "") for role in inserted[i]]
                if i < len(rows):
                    audit += edits[i][1]
                    out += [edits[i][2]] if edits[i][2] else []
            if GRAMMAR.fullmatch("".join(role[:1] for role, _ in out)) and all(role[:1] for role, _ in out) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def run(rows, found):
    code = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    repair = Repair()
    out = [row for (role, text), fault in zip(rows, found) for row in repair.feed(role, text, code[fault])]
    out += list(repair.finish())
    return repair.cost, repair.audit.decode(), out


def test_like_all_edits_of_short_conversations():
    rnd = random.Random(5)
    for _ in range(160):
        rows = [(rnd.choice(["user", "assistant", "system", "assistant", "tool", "", "User", "s"]), rnd.choice(["A.", "B!", "c", " ", "", "D?\n", "e. f"])) for _ in range(rnd.randrange(4))]
        found = faults(rows)
        assert run(rows, found) == cheapest(rows, found), rows


def additive(rows, found):
    """The same over whole audits as strings, without settling."""
    ways, after = {0: (0, "")}, ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(ways):
        best = dict(ways)
        for _ in range(6):
            for q, (c, a) in list(best.items()):
                new = (c + 3, a + "I")
                to = after[q][0]
                best[to] = min(best.get(to, new), new)
        return best

    for (role, _), fault in zip(rows, found):
        new = {}
        for q, (c, a) in inserted(ways).items():
            more = 3 * (fault == "truncated")
            steps = [(q, c + 4, a + "D")]
            if fault not in ("blank", "duplicate"):
                steps.append((after[q][0], c + 3 + more, a + "R"))
                if (q, role[:1]) in kept:
                    steps.append((kept[q, role[:1]], c + more, a + "K"))
            for to, cost, audit in steps:
                new[to] = min(new.get(to, (cost, audit)), (cost, audit))
        ways = new
    return min(w for q, w in inserted(ways).items() if q in (0, 3))


def test_long_conversations_settle_as_they_go():
    rnd = random.Random(6)
    for roles in (["user", "assistant"], ["assistant"], ["system"], ["user", "assistant", "system", "tool"]):
        for n in (1, 31, 32, 33, 500):
            rows = [(rnd.choice(roles), rnd.choice([f"t{i}.", f"t{i}", "", "x."])) for i in range(n)]
            found = faults(rows)
            cost, audit, out = run(rows, found)
            assert (cost, audit) == additive(rows, found)
            assert GRAMMAR.fullmatch("".join(role[:1] for role, _ in out))
    repair, longest = Repair(), 0
    for i in range(20_000):
        list(repair.feed(("user", "assistant")[i % 2], f"{i}.", 0))
        longest = max(longest, len(repair.waiting))
    assert longest <= 64 and repair.width <= 512


def order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


def report(rows):
    """Contract columns of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=order)
    plain = [(r, t) for _, r, t in rows]
    found = faults(plain)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
    cost, audit = additive(plain, found)
    out = run(plain, found)[2]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: report(own) for conv, own in convs.items()}


def test_query_like_plain_python(spark, tmp_path):
    rnd = random.Random(7)
    rows = []
    for conv in [*range(120), None]:
        for _ in range(rnd.choice([1, 2, 5, 9, 40])):
            turn = rnd.choice([None, *range(12)])
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", None, "Über", ""]), rnd.choice([None, "", " \n", "Yes.", "no", "Grüße!", "x" * 50_000 + ".", "多い。", "done.\t"])))
    rows += rows[:40]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).selectExpr("*", "'x' as report", "1 as place", "2 as here", "'k' as kind").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_conversation_repair(spark, str(tmp_path))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected(rows)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op12_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_extremes_of_turns_and_repaired_rows(spark):
    rows = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B."), (2, None, "assistant", "x."), (3, 1, "user", "gone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair_conversations(df, present=F.col("conv_id") != 3).collect()
    assert [(r.conv, r.place, r.role, r.text) for r in found if r.conv == 1 and r.place] == [(1, 1, "user", "A."), (1, 2, "assistant", "B.")]
    reports = {r.conv: r.report for r in found if r.report}
    assert reports[1].gaps == 2**63 - 1 and (reports[2].cost, reports[2].audit) == (3, "IK")
    assert tuple(reports[3]) == (0, 0, 0, 0, 0, 0, "")


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op12_conversation_repair(spark, sf).collect()}
    assert got == expected(rows)
