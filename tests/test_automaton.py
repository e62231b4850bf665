import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import automaton
from marlstone.operators.automaton import ANY, OTHER, SAME, Automaton, Step
from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"

CLASSES = {"head": lambda x: x.startswith("#"), "noise": lambda x: x.startswith("~"), "gate": lambda x: x == "BEGIN", "row": lambda x: F.substring(x, 1, 1).between("0", "9") if not isinstance(x, str) else x[:1].isdigit()}
TABLE = {
    ("closed", "gate"): Step("open"),
    ("open", "head"): Step(SAME, "end", set={"head": lambda x: F.substring(x, 2, 100)}, clear=("zone",)),
    ("open", "row"): Step("row", "begin"),
    ("row", "row"): Step("row", "begin"),
    ("row", "head"): Step("open", "end", set={"head": lambda x: F.substring(x, 2, 100)}, clear=("zone",)),
    ("row", OTHER): Step("row", "extend"),
    ("open", OTHER): Step("open", set={"zone": lambda x: x}),
    (ANY, "noise"): Step(SAME),
}
GRAMMAR = Automaton(CLASSES, TABLE, ("closed", "open", "row"), ("head", "zone"))


def plain(text):
    """The same machine, a line at a time."""
    state, head, zone, now, out = "closed", None, None, None, []
    for i, line in enumerate(text.split("\n")):
        kind = "head" if line.startswith("#") else "noise" if line.startswith("~") else "gate" if line == "BEGIN" else "row" if line[:1].isdigit() else OTHER
        step = TABLE.get((state, kind), TABLE.get((ANY, kind)))
        if step is None:
            continue
        if kind == "head" and step.set:
            head, zone = line[1:101], None
        elif step.set:
            zone = line
        state = state if step.to == SAME else step.to
        if step.action in ("begin", "end") and now:
            out.append(now)
            now = None
        if step.action == "begin":
            now = (i, [line], head, zone)
        elif step.action == "extend" and now:
            now[1].append(line)
    return [*out, *([now] if now else [])]


def test_rows_of_random_texts(spark):
    r = random.Random(2)
    pieces = ["# one", "#two", "~~ page 3", "BEGIN", "1 first", "22 second", "and more", "zone A", "", "  "]
    texts = [(i, "\n".join(r.choices(pieces, k=r.choice([0, 1, 5, 40, 300])))) for i in range(120)]
    texts += [(900, None), (901, ""), (902, "BEGIN\n" + "\n".join(f"{i} row\ntail" for i in range(3000))), (901, "BEGIN\n1 a")]
    df = spark.createDataFrame(texts, "id long, t string")
    found = sorted((x["id"], x["row_no"], x["first_line"], x["n_lines"], x["row_text"], x["head"], x["zone"]) for x in automaton.parsed(df, "id", "t", GRAMMAR).collect() if x["row_no"] is not None)
    want = sorted((i, k, first, len(lines), " ".join(lines), head, zone) for i, t in texts if t is not None for k, (first, lines, head, zone) in enumerate(plain(t)))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(found, key=key) == sorted(want, key=key) and len(want) > 3000


def test_no_shuffle(spark):
    df = catalog.QUERIES["grammar_rows"](spark, SF)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_wrong_tables_are_refused():
    for table in ({("nowhere", "head"): Step(SAME)}, {("open", "x"): Step(SAME)}, {("open", "head"): Step("nowhere")}, {("open", "head"): Step(SAME, "jump")}, {("open", "head"): Step(SAME, set={"z": lambda x: x})}):
        with pytest.raises(ValueError):
            Automaton(CLASSES, table, ("closed", "open", "row"), ("head",))
