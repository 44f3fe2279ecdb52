"""Training-data operators against brute force, exact round trips and edge cases."""

import json
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.llm import bpe, neighbours, ngram, packing, pairs, pii, queries, residue, scans, sentences, split


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary_path())


# --- 1


def test_pieces_fit_overlap_and_cover():
    rnd = random.Random(5)
    for _ in range(300):
        t = "".join(rnd.choice(["字", "ab", " ", "。", ". ", "\n", "\n\n", "ก", "é", "🙂"]) for _ in range(rnd.randint(1, 200)))
        size = rnd.randint(1, 60)
        overlap = rnd.randint(0, size - 1)
        ps = split.pieces(t, size, overlap)
        assert all(0 < e - a <= size for a, e, _ in ps) and ps[0][0] == 0 and ps[-1][1] == len(t)
        assert all(q[0] == p[1] - overlap and q[1] > p[1] for p, q in zip(ps, ps[1:]))


def test_pieces_cut_at_boundaries():
    t = "第一句话到这里。第二句话也到这里。第三句话。"
    assert [t[a:e] for a, e, _ in split.pieces(t, 18, 0)] == ["第一句话到这里。第二句话也到这里。", "第三句话。"]
    assert [r for *_, r in split.pieces("x" * 25, 10, 0)] == ["hard", "hard", "end"]


def test_split_edge_rows(spark):
    df = spark.createDataFrame(
        [(1, None, 5, 1, "k"), (2, "", 5, 1, "k"), (3, " abcdef ", 5, None, "k"), (4, "abcdef", 0, 1, "k"), (5, "abcdef", None, 1, "k"), (6, "abcdef", 3, 9, "k"), (6, "abcdef", 3, -2, "k")],
        "id bigint, content string, chunk_size int, chunk_overlap int, key string",
    )
    rows = split.split_oversized(df).collect()
    assert {r.key for r in rows} == {3, 6} and {r.overlap for r in rows if r.key == 6} == {2, 0}
    assert split.split_oversized(df.limit(0)).count() == 0


# --- 3


def vectors(spark, rows):
    models = spark.createDataFrame([("m", 3)], "model_name string, dims int")
    return neighbours.parse_vectors(spark.createDataFrame(rows, "key string, id bigint, embedding_json string, embedding_model string"), models)


def test_usable_vectors(spark):
    good = ["[1, 2.5, -3e-2]", " [0.1,0,0]"]
    bad = ["[0, 0, 0]", "[1, 2]", "[1, 2, NaN]", "1 2 3", "", None, "[1, 2, 3", '["1", 2, 3]', "[1, null, 3]", "[[1, 2, 3]]", "null", "[1, 2, 1e999]", "[1,2,3] x"]
    rows = [(f"c{i}", i, j, "m") for i, j in enumerate([*good, *bad])] + [("x", 99, "[1,2,3]", "other")]
    assert {r.key for r in vectors(spark, rows).collect()} == {"c0", "c1"}
    assert vectors(spark, rows[2:4]).count() == 0


def test_similar_pairs_and_recall(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    x[100:150] = x[:50] + 0.02 * rng.normal(size=(50, 16))
    x[150:230] = x[7]  # a class of copies
    text = [json.dumps([round(float(v), 5) for v in r]) for r in x]
    for name, id_ in (("document_chunks", "id"), ("sentence_nodes", "id"), ("document_summaries", "document_id")):
        part = [(i, t, "m") for i, t in enumerate(text)] if name == "document_chunks" else []
        spark.createDataFrame(part, f"{id_} bigint, embedding_json string, embedding_model string").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([("m", 16)], "model_name string, dims int").write.parquet(f"{tmp_path}/embedding_models.parquet")
    y = np.array([json.loads(t) for t in text])
    y /= np.linalg.norm(y, axis=1)[:, None]
    s = y @ y.T
    want = {tuple(sorted((f"c{a}", f"c{b}"))) for a, b in zip(*np.nonzero(np.triu(s >= 0.95, 1)))}
    got = {(r.key_a, r.key_b) for r in neighbours.found_pairs(spark, str(tmp_path)).collect()}
    big = {f"c{i}" for i in (7, *range(150, 230))}
    assert {p for p in want if not big & set(p)} == {p for p in got if not big & set(p)}
    assert {k for p in got if big >= set(p) for k in p} == big  # every copy is linked, through the class's smallest key
    hits = neighbours.nearest(spark, str(tmp_path)).collect()
    np.fill_diagonal(s, -2)
    by = {}
    for r in hits:
        by.setdefault(r.key, []).append(r.cosine)
    assert len(by) == 150 and all(len(v) == 10 for v in by.values())
    exact = {f"c{i}": np.sort(s[i])[-10] for i in range(0, 3000, 20)}
    assert sum(c >= exact[k] - 1e-6 for k, v in by.items() for c in v) / 1500 >= 0.9


def write_vectors(spark, path, rows, models):
    for name, id_ in (("document_chunks", "id"), ("sentence_nodes", "id"), ("document_summaries", "document_id")):
        part = [(i, json.dumps([round(float(v), 6) for v in x]), m) for i, (x, m) in enumerate(rows)] if name == "document_chunks" else []
        spark.createDataFrame(part, f"{id_} bigint, embedding_json string, embedding_model string").write.parquet(f"{path}/{name}.parquet")
    spark.createDataFrame(models, "model_name string, dims int").write.parquet(f"{path}/embedding_models.parquet")


def test_rare_models_and_crowded_prefixes(spark, tmp_path, monkeypatch):
    """A model of six vectors beside one of thousands keeps its pairs; a prefix that too many share is parted."""
    monkeypatch.setattr(neighbours, "SAMPLE", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8))
    x[:130] = x[0] + 1e-7 * rng.normal(size=(130, 8))  # near-copies share every bit
    rare = [np.arange(1, 5) + 0.01 * i for i in range(6)]
    write_vectors(spark, tmp_path, [(v, "a") for v in x] + [(v, "b") for v in rare], [("a", 8), ("b", 4)])
    got = {(r.key_a, r.key_b) for r in neighbours.found_pairs(spark, str(tmp_path)).collect()}
    y = np.array([[round(float(q), 6) for q in v] for v in x])
    y /= np.linalg.norm(y, axis=1)[:, None]
    want = {tuple(sorted((f"c{a}", f"c{b}"))) for a, b in zip(*np.nonzero(np.triu(y @ y.T >= 0.95, 1)))}
    want |= {tuple(sorted((f"c{a}", f"c{b}"))) for a in range(3000, 3006) for b in range(a + 1, 3006)}
    classes = {r.key: r for r in neighbours.class_links(spark, str(tmp_path)).collect()}
    assert len(classes) == 3006 and all(classes[f"c{i}"].links == 5 for i in range(3000, 3006))
    same = {(a, b) for a, b in want if classes[a].class_key == classes[b].class_key and classes[a].copies > neighbours.COPIES}
    crowd = {k for k, r in classes.items() if r.copies > neighbours.COPIES and k != r.class_key}
    missing = {(a, b) for a, b in want - same - got if a not in crowd and b not in crowd}
    assert len(missing) <= 0.01 * len(want) and got <= want
    hits = {r.key for r in neighbours.nearest(spark, str(tmp_path), every=1).where("key in ('c3000', 'c3005')").collect()}
    assert hits == {"c3000", "c3005"}


# --- 4


def test_checks_of_pairs():
    assert all(pairs.is_empty(t) for t in ["", " 　", "（空）", "[]", "​", "none", "N/A", "……", "无", "-", "﻿"])
    assert not any(pairs.is_empty(t) for t in ["好", "no way", "无聊", "🙂"])
    title = "怎样和前任谈呼吸练习？"
    assert all(pairs.is_copy(title, t) for t in [title, "怎样和前任谈 呼吸练习?", "Q: " + title, title + "\n" + title, "你的问题是：" + title])
    assert not pairs.is_copy(title, f"你问“{title}”，这句话本身就值得停一停。先坐下来。")
    assert pairs.tail("先写到这里。那一刻来访者") == "那一刻来访者" and pairs.tail("好。") == "" and pairs.tail("See No.") and not pairs.tail("It was no.")
    assert not pairs.tail("Read on. More: https://guide.example.org/b2") and pairs.unclosed("他写道：“我不想")
    assert pairs.script("你好 hello") == "latin" or pairs.script("你好世界 hello") == "zh"
    assert pairs.script("本当にそれでいいの") == "ja" and pairs.script("12 34") is None


def test_long_refusals():
    refusing = ["I cannot answer this question.", "I am unable to help with that request.", "Sorry, I will not give advice on this."]
    prose = ["Sit down and breathe slowly for a while.", "The morning walk made everything lighter.", "Write the letter and keep it."]
    models = {"refusal": ngram.Model(ngram.count_texts([pairs.plain(s) for s in refusing * 5])), "prose": ngram.Model(ngram.count_texts([pairs.plain(s) for s in prose * 5]))}
    judge = pairs.Judge({}, models, ())
    long = " ".join(refusing * 6)
    short = " ".join(["I cannot answer."] * 9)
    assert len(long) > 400 and judge.refuses([long, short, refusing[0], "", "?"]) == [True, True, True, False, False]
    assert judge.refuses([long + " " + prose[0], prose[0] + " " + long, " ".join(prose * 5)]) == [False] * 3


def test_counts_in_portions(monkeypatch):
    """Long texts are counted a portion at a time, to the same sums."""
    texts = [str(i) + "walk home slowly. " * 2_000 for i in range(30)] + [""]
    want, sizes, count = ngram.count_texts(texts), [], ngram.count_texts
    monkeypatch.setattr(ngram, "count_texts", lambda part: sizes.append(sum(map(len, part))) or count(part))
    tables = [np.zeros(1 << b, dtype=np.int64) for b in ngram.BUCKETS]
    ngram.count_into(tables, texts)
    assert all((x == y).all() for x, y in zip(tables, want)) and sum(sizes) == sum(map(len, texts))
    assert len(sizes) > 3 and max(sizes) < ngram.PORTION + 40_000


@pytest.mark.parametrize("block", [pairs.BLOCK, 8])
def test_openings_are_linked_wholly(spark, monkeypatch, block):
    """The clusters are the components of all links of Jaccard 0.5, however many openings hold a shingle."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    rnd = random.Random(7)
    words = ["walk", "letter", "breathe", "sister", "morning", "quiet", "answer", "sorry", "help", "cannot", "question", "friend"]
    texts = sorted({" ".join(rnd.sample(words, rnd.randint(2, 6))) + "." for _ in range(250)} | {"x" * 40, "ab c", "ab d"})
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.5 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    opened = spark.createDataFrame([(q, t) for q, t in enumerate(texts)] + [(0, texts[0]), (999, texts[0])], "question_id bigint, opening string")
    got = {r.opening: r for r in pairs.cluster_openings(opened).collect()}
    want, have = {}, {}
    for t, k in zip(texts, label):
        want.setdefault(k, set()).add(t)
        have.setdefault(got[t].cluster, set()).add(t)
    assert len(got) == len(texts) and sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))
    assert 5 < len(want) < len(texts) - 50 and all(got[t].n_prompts == len(c) + (texts[0] in c) for c in want.values() for t in c)


def test_each_opening_is_scored_once(monkeypatch):
    models = {"refusal": ngram.Model(ngram.count_texts(["i cannot help."] * 9)), "prose": ngram.Model(ngram.count_texts(["walk home slowly."] * 9))}
    judge, scored = pairs.Judge({}, models, ()), []
    ratios = pairs.Judge._sentence_ratios
    monkeypatch.setattr(pairs.Judge, "_sentence_ratios", lambda self, parts: scored.extend(x for p in parts for x in p) or ratios(self, parts))
    assert judge.refuses(["Walk home slowly. Walk slowly.", "Walk home slowly. I cannot help.", "I cannot help. I cannot help.", ""]) == [False, False, True, False]
    assert sorted(scored) == ["I cannot help.", "I cannot help.", "Walk home slowly."]


def test_quick_ways_of_checks(spark):
    """Long blanks, decorations and titles in parts take no other result than a reading of the whole text."""
    assert pairs.is_empty("." * 50 + "u n d e f i n e d" + " " * 50) and not pairs.is_empty("." * 50 + "undefined and so forth")
    assert pairs.is_copy("How are you?", "...  A: HOW are you") and not pairs.is_copy("How are you?", "Well, how are you?") and not pairs.is_copy("?", "?")
    assert pairs.undecorated("good 🙂 \n") == "good" and pairs.undecorated("a 🙂 b") == "a 🙂 b" and pairs.undecorated("") == ""
    texts = ["abcd efgh", "xyzw", "no", "", "abcd"]
    everywhere, _, blank = pairs._end_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    assert everywhere.sum() == 6 + 1 + 0 + 0 + 1 and everywhere[pairs.end_hash("abcd")] == 2 == blank[pairs.end_hash("abcd")] and blank.sum() == 4


def test_links_are_made_once(spark, tmp_path):
    def made(batches):
        for b in batches:
            for _ in range(len(b)):
                (tmp_path / f"{random.SystemRandom().getrandbits(64)}").touch()
            yield b

    links = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "id bigint, first bigint").mapInPandas(made, "id bigint, first bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id bigint")
    assert dict(pairs._components(nodes, links).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert len(list(tmp_path.iterdir())) == 3


def test_languages_of_many_texts():
    texts = ["", "walk", "home 12", "你好世界 hello", "你好 hello there", "12 34", "本当にそれでいいの", "私は日本語日本語日本語日本語日本語日本語日本語の", "Привет", "안녕", "नमस्ते", "\ud800", "é"]
    told = [None, "latin", "latin", "zh", "latin", None, "ja", "zh", "ru", "ko", "hi", None, "latin"]
    assert pairs.scripts(texts) == told == [pairs.script(t) for t in texts] and pairs.scripts([]) == []
    words = {"en": "walk home slowly and breathe ", "de": "geh langsam nach hause und atme "}
    judge = pairs.Judge({k: ngram.Model(ngram.count_texts([t * 20])) for k, t in words.items()}, {}, ())
    titles = ["walk and breathe", "atme langsam (messages 3)", "你好世界", None]
    judge.prepare(["geh langsam", "walk home", "geh nach hause", "walk slowly"], titles)
    assert {t: k for t, (k, _) in judge.asked.items()} == {t: judge.language(t)[0] for t in titles if t} == dict(zip(titles, ["en", "de", "zh"]))
    assert all(judge.asked[titles[0]][1][k] == pytest.approx(v) for k, v in judge.latin(titles[0]).items())
    assert [bool(scores) for _, scores in judge.said.values()] == [True, True, False, False]
    assert judge.other_language(titles[0], "geh langsam") and not judge.other_language(titles[1], "geh langsam nach hause")


# --- 5


def test_page_lines():
    lines = ["Notes on Sleep", "12", "a body line that goes on", "0", "1", "2", "3", "— l3 —", "Notes on Sleep", "more body."]
    numbers = scans.page_numbers(lines)
    assert numbers == {1, 7}
    assert scans.structure(lines, [scans.key("Notes on Sleep")]) == {0: "header", 1: "page_number", 7: "page_number", 8: "header"}
    assert scans.key("N o t e s  on SLEEP") == scans.key("Notes on sleep    14")
    assert scans.page_numbers(["y", "", "ordinary text."]) == set()


def test_damage(spark):
    clean = "the perhaps sleeping person walked towards the house and the well-being of perhaps sleeping people towards morning house."
    rows = [(i, "txt", clean + f" {clean}") for i in range(30)]
    page = "Notes on Sleep\n1\nthe perhaps slee-\nping person walked t0wards the well-\nbeing house.\nNotes on Sleep\n2\nand perhaps people."
    rows += [(100, "pdf", page), (101, "pdf", None), (102, "pdf", ""), (103, None, page)]
    df = spark.createDataFrame(rows, "doc_id bigint, loader string, content string")
    got = {(r.line_no, r.kind) for r in scans.damage(df).where("doc_id = 100").collect()}
    assert got == {(0, "header"), (1, "page_number"), (5, "header"), (6, "page_number"), (2, "hyphen"), (3, "misread")}
    assert scans.damage(df).where("doc_id != 100").count() == 0 and scans.damage(df.limit(0)).count() == 0
    fixed = scans.repaired(df).where("doc_id = 100").first().content
    assert fixed == "the perhaps sleeping person walked towards the well- being house. and perhaps people."
    plain = {r.doc_id: r.content for r in scans.repaired(spark.createDataFrame([(1, "pdf", "One line\nand on.\n\nTwo."), (2, "pdf", None), (3, "pdf", "")], df.schema)).collect()}
    assert plain == {1: "One line and on.\n\nTwo.", 2: None, 3: ""}


def test_recase():
    assert scans.recase("T0WARDS", "towards") == "TOWARDS" and scans.recase("Rnorning", "morning") == "Morning" and scans.recase("c1ient", "client") == "client"


def test_misread_common_characters(spark):
    people = "友亲事学师生"
    clean = [f"那位{p}信自己的话，他{p}已经{q}来，而且{p}说他会来。" for p in people for q in "回出进"]
    rows = [(i, "txt", t) for i, t in enumerate(clean * 20)] + [(1000 + i, "pdf", t) for i, t in enumerate(clean * 8)]
    rows += [(2000 + i, k, f"那位{p}说她会来。") for i, (k, p) in enumerate([(k, p) for k in ("pdf", "txt") for p in people * 2])]
    rows += [(2500 + i, "txt", "她有她的家，她也有她的路。") for i in range(20)]
    wrong = [t.replace("自己", "自已") for t in clean] + [t.replace("已经", "己经") for t in clean]
    rows += [(3000 + i, "pdf", f"第一行没有什么。\n{t}") for i, t in enumerate(wrong)]
    df = spark.createDataFrame(rows, "doc_id bigint, loader string, content string")
    got = {(r.doc_id, r.line_no) for r in scans.damage(df).where("kind = 'misread'").collect()}
    assert got == {(3000 + i, 1) for i in range(len(wrong))}


def test_counts_of_words_and_neighbours(monkeypatch):
    """Counts over arrays equal counts one by one; a key is made once for a line that comes again."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("我们好的是ab- \n\n\x0c1é后ก") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["我", "", "𠀀我们\n好"]
    rows = pd.DataFrame({"content": texts, "scanned": [i % 2 == 0 for i in range(len(texts))]})
    want = {}
    for t, scanned in zip(texts, rows["scanned"]):
        plain = t.replace("\x0c", "")
        whole, lines = plain.replace("\n", ""), plain.split("\n") if scanned else []
        for k, part in [("whole", whole), *(("inside", line) for line in lines)]:
            for a, c, x in zip(part, part[1:], part[2:]):
                if c in "我们好的是后ก𠀀":
                    n = want.setdefault((a + x, c), [0, 0, 0])
                    n[0] += k == "whole"
                    n[1] += k == "whole" and not scanned
                    n[2] += k == "inside"
    monkeypatch.setattr(scans, "portions", lambda v: ngram.portions(v, 200))
    got = pd.concat(list(scans._words(iter([rows[:100], rows[100:]]))))
    assert {(r.x, r.c): [r.n, r.clean, r.inside] for r in got[got["kind"] == "g"].itertuples()} == want
    words = dict(zip(got[got["kind"] == "w"]["x"], got[got["kind"] == "w"]["n"]))
    lines = [line.rstrip() for t in texts for line in t.split("\n")]
    assert words == Counter(w for s in lines for w in (scans.WORD.findall(s)[:-1] if s[-1:] in scans.HYPHENS and s else scans.WORD.findall(s)))
    made = []
    monkeypatch.setattr(scans.unicodedata, "normalize", lambda form, t: made.append(t) or t)
    assert [scans.key("Ein Titel 8 zweimal") for _ in range(3)] == ["eintitelbzweimal"] * 3 and len(made) == 1


# --- 6


def test_residue(spark):
    people = ["怎样和前任谈呼吸练习？", "How do I stop hiding behind excuses?", "导师说我的论文像 lorem ipsum，我很受伤", "写代码时看到 {} 就心慌怎么办？", "【求助】室友冷战怎么办", "[update] I finally talked"]
    bad = ["关于{{城市}}，我想听听", "__age__ years", "来自[topic]的提问", "lorem ipsum dolor", "test test test test", "404 Not Found", "请启用 JavaScript 后继续访问"]
    rows = [(i, t, None) for i, t in enumerate([*[p for p in people if "lorem" not in p] * 8, people[2]])] + [(1000 + i, t, "") for i, t in enumerate([*bad, "#{topic} ok?"])]
    q = spark.createDataFrame(rows, "id bigint, title string, description string")
    corpus = spark.createDataFrame([("改变很慢，但已经不一样了。怎样谈练习？ How do I talk about it?",)] * 20 + [(None,)], "text string")
    found = {r.question_id for r in residue.residue(q, corpus).collect()}
    assert found == {1000 + i for i in range(len(bad) + 1)}
    assert residue.residue(q.limit(0), corpus).count() == 0


def test_wanted_fields(spark):
    """Fields that aren't wanted teach the models and the names all the same."""
    rows = [(i, f"How do I sleep well on night {i}?", "I lie awake and walk about the house.") for i in range(40)]
    rows += [(100, "lorem ipsum dolor sit amet", "404 not found"), (101, "Dear [mood_word]", "so {{mood_word}} today"), (102, None, "lorem ipsum")]
    questions = spark.createDataFrame(rows, "id bigint, title string, description string")
    corpus = spark.createDataFrame([("Sit down and breathe, then sleep comes.",)] * 20, "text string")
    titles = residue.residue(questions, corpus, ("title",)).collect()
    assert sorted(titles) == sorted(residue.residue(questions, corpus).where("field_name = 'title'").collect())
    assert {r.question_id: r.kind for r in titles} == {100: "filler", 101: "placeholder"}


def test_equal_fields_are_scored_once(monkeypatch):
    count = lambda *t: ngram.Model(ngram.count_texts([*t] * 9))
    detector = residue.Detector({"prose": count("walk home slowly"), "filler": count("lorem ipsum"), "notice": count("page not found")})
    texts = ["Lorem ipsum 1", "walk home", "", "!?", "lorem ipsum 22", "walk home", "lorem", "page not found page not found, walk home"]
    alone = [detector.coverage([t]) for t in texts]
    scored, codes = [], residue.codes
    monkeypatch.setattr(residue, "codes", lambda t: scored.extend(t) or codes(t))
    share, notice = detector.coverage(texts)
    assert sorted(scored) == ["!?", "lorem", "lorem ipsum 0", "page not found page not found, walk home", "walk home"]
    assert share.tolist() == [s[0] for s, _ in alone] and share[0] == share[4] == share[6] == 1 and share[1] == share[2] == share[3] == 0
    assert notice.tolist() == [n[0] for _, n in alone] and 0 < share[7] < 1
    assert [residue.seed_label(t) for t in ["Lorem Ipsum!", "404: Page not found", "abababab", "walk home", "12", "?", "ERROR"]] == ["filler", "notice", "filler", None, None, None, "notice"]


def test_filler_of_repeated_words(spark):
    rnd = random.Random(3)
    prose = [a + b for a in ("walk", "talk", "wait", "rest") for b in ("ing", "ed", "er", "s", "")]
    made = ["iptator", "normi", "doveta", "tortor", "finsum", "rasve", "remcu", "tatorlo"]
    text = lambda words: " ".join(rnd.choice(words) for _ in range(9))
    corpus = spark.createDataFrame([(text(prose),) for _ in range(200)], "text string")
    rows = [(i, "title", text(prose)) for i in range(40)] + [(100 + i, "title", text(made)) for i in range(20)]
    fields = spark.createDataFrame(rows, "question_id bigint, field_name string, text string")
    found = {r.question_id for r in residue._bootstrap(fields, corpus).where("label = 'filler'").collect()}
    assert found == set(range(100, 120))
    few = spark.createDataFrame([("we wait and rest",)], "text string")  # so little prose says nothing
    assert residue._bootstrap(fields, few).where("label = 'filler'").count() == 0


# --- 7


def test_units_cover_and_split():
    counts = sentences.Counts()
    t = "# 标题\n\n“好。”前任说。那位同事写道：“我不想。真的不想。”别怕！\n\n- 第一条。还有。\n- 第二条\n\n没有句号的一行\n又一行没有句号"
    got = [t[a:e] for a, e in sentences.units(t, counts)]
    assert got == ["# 标题", "“好。”前任说。", "那位同事写道：“我不想。真的不想。”", "别怕！", "- 第一条。还有。", "- 第二条", "没有句号的一行", "又一行没有句号"]
    wrapped = "We met at\nnoon and left. She said nothing;\nthen it rained."
    assert [wrapped[a:e] for a, e in sentences.units(wrapped, counts)] == ["We met at\nnoon and left.", "She said nothing;\nthen it rained."]
    rnd = random.Random(2)
    for _ in range(300):
        x = "".join(rnd.choice(["字", "ab ", " ", "。", ". ", "\n", "\n\n", "กข ", "“", "”", "「", "」", '"', "?", "…", "1. "]) for _ in range(60))
        seen = [0] * len(x)
        for a, e in sentences.units(x, counts):
            assert not x[a].isspace() and not x[e - 1].isspace()
            for k in range(a, e):
                seen[k] += 1
        assert all(n == 1 for n, c in zip(seen, x) if c not in sentences.SPACE)


# --- 8


def test_exact_encoding(encoder, spark):
    import tiktoken

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()]
    rnd = random.Random(9)
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x4E00, 0x4F00), rnd.randrange(0x1F600, 0x1F640), 10, 32])) for _ in range(80)) for _ in range(200)]
    texts += ["<|endoftext|>", " ", "\n\n  x", "a" * 3000, "don't 've"]
    ref = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    assert all(encoder.encode(t) == ref.encode_ordinary(t) for t in texts)
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "hi")], "doc_id bigint, text string")
    assert sorted((r.doc_id, len(r.ids)) for r in bpe.encode_corpus(df).collect()) == [(1, 0), (2, 0), (2, 0), (3, 1)]


# --- 9


@pytest.mark.parametrize("capacity", [64, 512, 2048])
def test_plan_places_everything_once(capacity):
    rng = np.random.default_rng(capacity)
    items = np.concatenate([rng.integers(1, capacity + 1, 4000), np.full(3000, capacity // 3), rng.integers(1, 20, 2000).clip(max=capacity)])
    sizes, counts = np.unique(items, return_counts=True)
    fill, placed = {}, dict.fromkeys(sizes.tolist(), 0)
    for size, a, e, each, first, offset, _ in packing.plan(sizes, counts, capacity):
        placed[size] += e - a
        for c in first + (np.arange(e - a) + offset) // each:
            fill[c] = fill.get(c, 0) + size
    assert placed == dict(zip(sizes.tolist(), counts.tolist())) and max(fill.values()) <= capacity
    assert len(fill) <= 1.03 * -(-items.sum() // capacity) + 2 or capacity == 64


def test_pack(spark):
    docs = spark.createDataFrame([(1, "a b c " * 400), (2, None), (3, ""), (4, "hi"), (4, "hi")], "doc_id bigint, text string")
    packs = spark.createDataFrame([(1, "byte_bpe_50k", 100), (2, "byte_bpe_50k", None)], "pack_id bigint, tokenizer string, capacity int")
    rows = packing.pack(docs, packs).collect()
    full = {}
    for r in rows:
        full[r.container] = full.get(r.container, 0) + r.n_tokens
    assert max(full.values()) <= 100 and sum(r.n_tokens for r in rows if r.doc_id == 1) > 1000 and len([r for r in rows if r.doc_id == 4]) == 2
    assert packing.pack(docs.limit(0), packs).count() == 0


# --- 10


def test_mentions(spark):
    people = ["联系人：林北荞 电话15600000337", "姓名：温漾青，身份证990523196602123218。", "姓名：叶榆白，证件990438196107044159。", "我叫苏舟梨。", "我叫林榆青，来自南方"]
    people += [f"昨天来访者{n}住在南梧。" for n in ("温漾青", "叶榆白", "苏舟梨", "林榆青")]  # a context that names share, learned from the others
    text = "订单号15783730972已经退款。写信到linmu [at] example [dot] org，抄送a.b@example.net。来访者林北荞住在南梧市听澜街79号2单元840室。"
    more = ["Contact: Orla Pellisk, 299-555-0170, x", "I am Orla Pellisk and my number is (560) 555-0165.", "Contact: Jory Tarrow, +44 20 7946 0630, y", "I am Jory Tarrow and so on"]
    rows = [(i, t) for i, t in enumerate(people * 3 + more * 2)] + [(100, text), (101, "Tarrow never came back. Ticket 936-875-6075A was closed."), (102, None), (103, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.mentions(df).collect()
    at = lambda d, t: {(t[r.start_char : r.end_char], r.kind) for r in found if r.doc_id == d}
    assert at(100, text) == {("linmu [at] example [dot] org", "email"), ("a.b@example.net", "email"), ("林北荞", "name"), ("南梧市听澜街79号2单元840室", "address")}
    assert at(101, rows[-3][1]) == {("Tarrow", "name")}
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert clean[102] is None and clean[103] == "" and clean[101].startswith("[NAME] never")
    assert pii.mentions(df.limit(0)).count() == 0


def test_us_numbers():
    assert all(pii.PHONE.fullmatch(t) for t in ["212-867-5309", "+1 212-867-5309", "212.867.5309", "299-555-0170", "(560) 555-0165"])
    assert not any(pii.PHONE.search(t) for t in ["936-875-6075A", "212-067-5309", "1212-867-5309"]) and pii.NOT_BEFORE.search("Ticket ")


# --- all


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
    if name == "p1_found":
        import duckdb

        duckdb.sql(f"create or replace view document_chunks as select * from '{sf}/document_chunks.parquet'")
        assert sorted(r.chunk_id for r in df.collect()) == sorted(x for (x,) in duckdb.sql(queries.P1_SQL).fetchall())


def test_pairs_on_empty_tables(spark):
    a = spark.createDataFrame([], "id bigint, question_id bigint, draft string, edited string")
    q = spark.createDataFrame([], "id bigint, title string")
    d = spark.createDataFrame([], "lang string, text string")
    assert pairs.judge_pairs(a, q, q.select(F.col("id").alias("question_id")), d).count() == 0
    one = spark.createDataFrame([(1, None, "", None), (2, 5, "那一刻来访者", "好。"), (2, 5, "那一刻来访者", "好。")], a.schema)
    got = sorted(map(tuple, pairs.judge_pairs(one, q, q.select(F.col("id").alias("question_id")), d).collect()))
    assert got == [(1, "draft", "empty"), (2, "draft", "truncated"), (2, "draft", "truncated")]


def test_sentences_on_empty_table(spark):
    e = spark.createDataFrame([], "rec_table string, rec_id bigint, text string")
    assert sentences.sentence_units(e).count() == 0
