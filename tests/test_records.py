"""Results back to records: hand cases, splitting of groups, odd rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import spans as S
from quire.functions import text as T
from quire.operators import records as R

TOKEN = "array<struct<token_tag:string,token_type:string,restore_text:string>>"
RECORD = f"doc_id int, item_id string, pos int, source string, tokens {TOKEN}, should_translate boolean, label string, final_status string, continuation_group string, unit_id string, tail_prefix string, protected_translated_text string, translated_text string, unit_translated_text string"
RESULT = "doc_id int, unit_id string, seq int, decision string, translated_text string, final_status string"


def record(item, pos, source, **more):
    return (1, item, pos, source, more.get("tokens", []), more.get("should", True), "old", "pending", more.get("group"), more.get("unit"), more.get("prefix"), "was", "was", "was")


def brute_repair(source, output):
    """The first way through the output that gives the source's placeholders in order."""
    want, found = re.findall(T.PLACEHOLDER, source), list(re.finditer(T.PLACEHOLDER, output))
    got = [m[0] for m in found]
    if not want or len(got) <= len(want) or set(got) - set(want):
        return None
    keep, at = set(), 0
    for p in want:
        while at < len(got) and got[at] != p:
            at += 1
        if at == len(got):
            return None
        keep.add(at)
        at += 1
    out = output
    for k in range(len(found) - 1, -1, -1):
        if k not in keep:
            out = out[: found[k].start()] + out[found[k].end() :]
    out = re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"[ \t]{2,}", " ", out))
    return out.strip() if re.findall(T.PLACEHOLDER, out) == want else None


def test_repair_of_repeated_placeholders(spark):
    rng = random.Random(3)
    tags = ["<f1-abc/>", "<f2-abd/>", "<t1-a0f/>", "@@P1@@"]
    pairs = []
    for _ in range(400):
        src = [rng.choice(tags) for _ in range(rng.randrange(0, 4))]
        out = [t for t in src for _ in range(rng.choice([1, 1, 2]))] + rng.choices(tags, k=rng.randrange(0, 2))
        rng.random() < 0.3 and rng.shuffle(out)
        mix = lambda s: "".join(f"w{k}{rng.choice([' ', '', '  '])}{t}{rng.choice([' ', '', ' ,', ' .'])}" for k, t in enumerate(s))
        pairs.append((mix(src), mix(out)))
    df = spark.createDataFrame(pairs, "s string, o string")
    got = df.select("s", "o", R.repair_duplicates(F.col("s"), F.col("o")).alias("r")).collect()
    assert all(r["r"] == brute_repair(r["s"], r["o"]) for r in got)
    assert sum(r["r"] is not None for r in got) > 60


def test_shells_are_opened(spark):
    cases = {
        "plain": "plain", '{"translated_text": " a "}': "a", '```json\n{"translated_text": "{\\"translated_text\\": \\"deep\\"}"}\n```': "deep", '{"translations": [{"item_id": "x", "translated_text": "no"}, {"item_id": "i", "translated_text": "mine"}]}': "mine",
        '{"translations": [{"item_id": "x", "translated_text": "only"}]}': "only", '{"translations": [{"item_id": "x", "translated_text": "a"}, {"item_id": "y", "translated_text": "b"}]}': None, "translated_text {broken": None, "": "",
    }
    got = {r["t"]: r["u"] for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", R.unwrap(F.col("t"), F.lit("i")).alias("u")).collect()}
    assert got == {k: k if v is None else v for k, v in cases.items()}


def test_states_units_and_texts(spark):
    f1 = [("<f1-abc/>", "formula", "$x_1$")]
    rows = [
        record("a", 0, "one two <f1-abc/>", group="g", tokens=f1), record("b", 1, "three four five six seven", group="g"), record("c", 2, "skipped member", group="g", should=False), record("d", 3, "alone", group="h"), record("e", 4, "We find that", tokens=f1),
        record("f", 5, "$y^2$ holds."), record("g", 6, "tail", prefix="Listing:"), record("h", 7, "none"), record("i", 8, "kept"), record("j", 9, "failed"), record("k", 10, "x", unit="__cg__:u"), record("l", 11, "y", unit="__cg__:u"), record("m", 12, None),
    ]
    results = [
        (1, "__cg__:g", 0, "translate", "甲乙 <f1-abc/> 丙丁。戊己庚辛壬癸", None), (1, "e", 0, "translate", "我们发现这个量总是守恒，等于 $y^2$ 成立。", None), (1, "g", 0, "translate", ", done", None), (1, "i", 0, "KEEP-origin", "x", None), (1, "j", 0, "translate", "y", "failed"),
        (1, "k", 5, "translate", "last", None), (1, "k", 1, "translate", "first", None), (1, "nobody", 0, "translate", "z", None), (1, "f", 0, None, "保持简洁 按照规则 bla\n因此输出：完成", None), (1, None, 0, None, None, None),
    ]
    out = R.apply_results(spark.createDataFrame([(*r, 7) for r in rows], RECORD + ", rank int"), spark.createDataFrame(results, RESULT)).collect()
    got = {r["item_id"]: r for r in out}
    assert len(out) == len(rows) and got["a"]["rank"] == 7
    assert {got[k]["unit_id"] for k in "abc"} == {"__cg__:g"} and got["d"]["unit_id"] == "d" and got["d"]["unit_kind"] == "single"
    assert got["a"]["unit_translated_text"] == "甲乙 $x_1$ 丙丁。戊己庚辛壬癸" and got["c"]["translated_text"] == "" and got["c"]["final_status"] == "pending"
    parts = [got[k]["protected_translated_text"] for k in "ab"]
    assert "甲乙 <f1-abc/> 丙丁。戊己庚辛壬癸".startswith(parts[0]) and parts[1] and "$x_1$" in got["a"]["translated_text"] + got["b"]["translated_text"]
    assert got["e"]["translated_text"] == "我们发现这个量总是守恒" and got["e"]["final_status"] == "partially_translated"
    assert (got["f"]["translated_text"], got["f"]["final_status"]) == ("完成", "partially_translated")
    assert got["g"]["translated_text"] == "Listing:, done" and got["h"]["translated_text"] == "was" and got["h"]["final_status"] == "pending"
    assert (got["i"]["final_status"], got["i"]["should_translate"], got["i"]["label"], got["i"]["translated_text"]) == ("kept_origin", False, R.KEPT_LABEL, "")
    assert (got["j"]["final_status"], got["j"]["should_translate"], got["j"]["label"], got["j"]["translated_text"]) == ("failed", True, "", "")
    assert (got["k"]["translated_text"], got["k"]["unit_id"], got["k"]["unit_kind"]) == ("last", "__cg__:u", "group") and got["l"]["translated_text"] == "was"


def test_groups_are_dealt_out_whole(spark):
    rng = random.Random(5)
    rows, results, want = [], [], {}
    for g in range(60):
        n = rng.randrange(2, 6)
        rows += [record(f"{g}-{k}", g * 10 + k, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))), group=f"g{g}") for k in range(n)]
        want[g] = "".join(rng.choice("甲乙丙丁，。 a") for _ in range(rng.randrange(5, 60))).strip()
        results.append((1, f"__cg__:g{g}", 0, "translate", want[g], None))
    out = R.apply_results(spark.createDataFrame(rows, RECORD), spark.createDataFrame(results, RESULT)).collect()
    parts = {}
    for r in sorted(out, key=lambda r: r["pos"]):
        parts.setdefault(int(r["item_id"].split("-")[0]), []).append(r["translated_text"])
    squeeze = lambda t: re.sub(r"\s", "", t)
    assert all(squeeze("".join(p)) == squeeze(want[g]) for g, p in parts.items())


def test_weights(spark):
    texts = ["", "one two <f1-abc/>", "中文, a-b/c.d [[FORMULA_3]] < $x$", "  \n\t x", None, "é§"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.text_weight(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [pytest.approx(max(1.0, S.text_units(r["t"]))) for r in got]


def test_empty_tables_and_repeats(spark):
    none, rows = spark.createDataFrame([], RESULT), spark.createDataFrame([record("a", 0, "x"), record("a", 0, "x")], RECORD)
    assert Counter(r["final_status"] for r in R.apply_results(rows, none).collect()) == Counter({"pending": 2})
    assert R.apply_results(rows.limit(0), none).count() == 0
