"""Labels by text: what makes them cheap changes none of them."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import DATA
from quire.functions import text as T
from quire.operators import policy as P
from quire.operators.records import WORD_SIGN


def test_white_space_is_the_same_as_listed(spark):
    plain = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
    df = spark.createDataFrame([(chr(k),) for k in range(0x11000) if not 0xD800 <= k < 0xE000], "c string")
    inside = lambda p: f"{WORD_SIGN[:-1]}{p[1:]}"
    odd = df.where((F.col("c").rlike(plain) != F.col("c").rlike(T.SPACES)) | (F.col("c").rlike(inside(plain)) != F.col("c").rlike(inside(T.SPACES))))
    assert odd.count() == 0 and df.where(F.col("c").rlike(T.SPACES)).count() == 29


ROWS = [
    (0, "body", "DO10I = 1,20 ; A(I) = B(I)/C(I) + D(I)", "code"), (0, "body", "the loop DO1I is told of here", ""), (0, "body", "the loop of DO1I = and of B2 here", "code"), (0, "body", "A(I) B(I) C(I) D(I) E(I) F(I) G(I) words here too", "code"),
    (0, "title", "DO10I = 1,20 ; A(I) = B(I)/C(I) + D(I)", ""), (8, "body", "Copyright 2020 Example Press. All rights reserved.", "skip_metadata_fragment"), (9, "body", "Copyright 2020 Example Press. All rights reserved.", ""),
    (0, "body", "This trademark and copyright text accepts no liability for anything.", ""), (0, "body", "这是一个关于模型能量计算的中文段落文本测试样例 abc", "skip_cjk_source_body"), (0, "body", "这是一个关于模型能量 plain words here", ""), (0, "body", None, ""),
    (0, "body", "éééééééééé éééééééééé éééééééééé", ""),
]


def labelled(spark, rows):
    made = [(k, p, k, t, role == "title", role != "title", "text") for k, (p, role, t, _) in enumerate(rows)]
    return spark.createDataFrame(made, "id int, page_idx long, block_idx int, text string, is_title_like boolean, is_bodylike boolean, kind string")


def test_content_labels_before_a_cutoff_is_joined_are_those_after_it(spark):
    rows = labelled(spark, ROWS)
    early = P.content_labels(rows)
    assert [r["content_label"] for r in early.orderBy("id").collect()] == [label for *_, label in ROWS]
    cut = {"cutoff_page": F.when(F.col("id") % 2 == 0, 0), "cutoff_block": F.lit(3)}
    a, b = (P.apply_policies(df.withColumns(cut)).select("id", "label", "should_translate") for df in (rows, early))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert [r["label"] for r in a.orderBy("id").collect()][2:6] == ["code", "code", "skip_title", "skip_metadata_fragment"]


def test_texts_stay_behind_where_labels_meet_cutoffs(spark):
    def joins(plan):
        own = [plan] if plan.nodeName() == "Join" else []
        return own + [j for k in range(plan.children().size()) for j in joins(plan.children().apply(k))]

    for name in ("policies_applied", "page_summaries"):
        [join] = joins(entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan())
        columns = {c.split("#")[0] for c in join.output().mkString(",").split(",")}
        assert "content_label" in columns and "text" not in columns
