import json
import random

from quernstone.operators.packed import split_packed


def tags(spark, *fields):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "id int, t string")
    got = [[] for _ in fields]
    for r in split_packed(df, "id", "t").orderBy("question_id", "pos").collect():
        assert r.pos == len(got[r.question_id])
        got[r.question_id].append(r.tag)
    return got


def test_forms(spark):
    got = tags(
        spark, '"yes, and"、焦虑、30+', "原生家庭 睡眠", "anger management", '["a, b","c"]', "#情绪 #分手", "孤独 / 哀伤",
        "|沟通|A/B|R&B 歌单|", '"所谓""原生家庭"""、“work, then rest”', "'爱;恨'", "亲密关系　内向", "don't, stop", "first-year students，shame",
    )
    assert got == [
        ["yes, and", "焦虑", "30+"], ["原生家庭", "睡眠"], ["anger management"], ["a, b", "c"], ["情绪", "分手"], ["孤独", "哀伤"],
        ["沟通", "A/B", "R&B 歌单"], ['所谓"原生家庭"', "work, then rest"], ["爱;恨"], ["亲密关系", "内向"], ["don't", "stop"], ["first-year students", "shame"],
    ]


def test_nothing_and_malformed(spark):
    assert tags(spark, None, "", " ", "，，", ",", "[]", '""') == [[]] * 7
    df = spark.createDataFrame([(1, '"abc, d', "x")], "id int, t string, pos string")
    rows = split_packed(df, "id", "t").collect()
    assert [(r.pos, r.tag, r.malformed) for r in rows] == [(0, '"abc', True), (1, "d", False)]


def test_empty_table_and_long_field(spark):
    assert split_packed(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0
    assert len(tags(spark, "，".join(["值"] * 5000))[0]) == 5000


def test_round_trip(spark):
    """Values joined with any one separator, quoted where needed, come back in order, repeated ones too."""
    rnd, fields, want = random.Random(3), [], []
    for _ in range(200):
        vals = [rnd.choice(["焦虑", "a, b", "x；y", 'say "no"', "30+", "work/life"]) for _ in range(rnd.randint(1, 6))]
        if rnd.random() < 0.3:
            fields.append(json.dumps(vals, ensure_ascii=False))
        else:
            q = ['"' + v.replace('"', '""') + '"' if any(c in v for c in ',；"') or rnd.random() < 0.2 or "/" in v else v for v in vals]
            fields.append(rnd.choice([",", "，", " ; ", "|", "\n", "、"]).join(q))
        want.append(vals)
    assert tags(spark, *fields) == want


def test_very_long_values(spark):
    """A value of a million characters in each form neither overflows the matcher's stack nor takes quadratic time."""
    n = 1_000_000
    x, words = "字" * n, "word " * (n // 5)
    fields = [x, f'"{x}"', f'"{x}', f"'{x}'", f"“{x}”", f"#{x}", f"[{x}]", words.strip(), "“," * (n // 2), f'a, "{chr(34) * 2 * (n // 2)}"', "a" + " " * n + "字", f"{x}/{x}"]
    got = tags(spark, *fields)
    assert got[0] == got[1] == got[3] == got[4] == got[5] == got[6] == [x] and got[2] == ['"' + x] and got[7] == [words.strip()]
    assert len(got[8]) == n // 2 and got[9] == ["a", '"' * (n // 2)] and got[10] == ["a", "字"] and got[11] == [x, x]
