"""Operators on texts: brute force, properties and awkward inputs."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from cairnflow.llm.leakage import RUN, Index, leaked_items, searched_items
from cairnflow.llm.mixing import capped_mean, cumulative, mixed, solved_rate
from cairnflow.llm.quality import Common, described, text_quality
from cairnflow.llm.tokens import with_tokens
from cairnflow.llm.words import words


def by_hand(docs, items):
    def norm(t, joined):
        t = unicodedata.normalize("NFKC", (t or "").replace("\xad", "")).casefold()
        return re.findall(r"[^\W_]+", re.sub(r"-\s*\n\s*", "" if joined else "-\n", t))

    grams = {}
    for i, t in items:
        w = norm(t, False)
        for k in range(len(w) - RUN + 1):
            grams.setdefault(tuple(w[k : k + RUN]), set()).add(i)
    found = set()
    for d, t in docs:
        for joined in (False, True):
            w = norm(t, joined)
            for k in range(len(w) - RUN + 1):
                found |= {(d, i) for i in grams.get(tuple(w[k : k + RUN]), ())}
    return found


def test_leaks_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/eval_items.parquet")
    want = by_hand(docs.select("doc_id", "text").collect(), items.select("item_id", "item_text").collect())
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == want and want


def test_leaks_at_random(spark):
    rnd = random.Random(5)
    names = [a + b for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vik", "dor", "pa")]
    items = [(i, " ".join(rnd.choices(names, k=rnd.randint(8, 40)))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for d in range(200):
        text = rnd.choices([*names, "other", "words"], k=rnd.randint(0, 60))
        own = items[rnd.randrange(40)][1].split()
        n = rnd.choice([10, 11, 12, 13, 25])
        a = rnd.randint(0, max(0, len(own) - n))
        at = rnd.randint(0, len(text))
        text[at:at] = own[a : a + n]
        docs.append((d, rnd.choice([" ", ", ", " \n"]).join(text).title(), "clash"))
    docs += [(500, None, ""), (501, "", ""), (502, docs[3][1] * 300, ""), (3, docs[3][1], "again")]
    df = spark.createDataFrame(docs, "doc_id int, text string, item_id string")
    it = spark.createDataFrame(items, "item_id int, item_text string")
    got = leaked_items(df, it).collect()
    want = by_hand([d[:2] for d in docs], items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.longest_run >= RUN and 0 < r.item_share <= 1 for r in got)
    assert leaked_items(df, it.where("false")).count() == 0 and leaked_items(df.where("false"), it).count() == 0


@pytest.mark.parametrize("exponent", [1.05, 1.4])
def test_no_leak_is_under_a_threshold(exponent):
    rnd = np.random.default_rng(3)
    texts = [[f"w{x}" for x in rnd.zipf(exponent, rnd.integers(5, 90))] for _ in range(120)]
    texts += [["w1"] * 30, ["w1", "w2"] * 20, texts[7][:], [w for t in texts[:40] for w in t]]
    index = Index([(i, " ".join(t)) for i, t in enumerate(texts)])
    assert sorted(index.ids) == [i for i, t in enumerate(texts) if len(t) >= RUN]
    number = index.vocabulary
    for i, own in enumerate(texts):
        for at in range(0, len(own) - RUN + 1, 5):
            text = [f"w{x}" for x in rnd.zipf(exponent, rnd.integers(0, 20))] + own[at : at + RUN] + [f"w{x}" for x in rnd.zipf(exponent, 9)]
            grams = {tuple(text[k : k + RUN]) for k in range(len(text) - RUN + 1)}
            want = {j for j, t in enumerate(texts) if any(tuple(t[k : k + RUN]) in grams for k in range(len(t) - RUN + 1))} if at == 0 else {i}
            got = {int(index.ids[j]) for _, j in index.found(np.array([number.get(w, index.n_words) for w in text]))}
            assert want <= got and (at or want == got)


def test_leaks_over_many_shards(spark):
    rnd = np.random.default_rng(8)
    items = [(i, " ".join(f"w{x}" for x in rnd.zipf(1.2, 40))) for i in range(300)] + [(1000, "one two"), (1001, None), (None, "x " * 40), (5, "w1 " * 20)]
    docs = [(d, " ".join([*(f"w{x}" for x in rnd.zipf(1.2, 15)), *items[d * 3][1].split()[10:30]])) for d in range(90)] + [(900, "w1 " * 500)]
    df, it = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, item_text string")
    want = by_hand(docs, [x for x in items if x[0] is not None])
    for sent in (150_000, 1 << 28):
        got = leaked_items(df, it, shard_bytes=4000, sent_bytes=sent)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    report = {r.item_id: r for r in searched_items(it, got).collect()}
    assert report[1000].searchable is False and report[1001].n_words == 0 and report[3].searchable and len(report) == 302
    assert {i: r.n_docs for i, r in report.items() if r.n_docs} == dict(Counter(i for _, i in want))


def test_question_and_answer(spark):
    ask = "question nine why does the third lens drift so far overnight in the cold room"
    reply = "answer because the glue of the mount creeps under its own weight when it is wet"
    it = spark.createDataFrame([(1, f"{ask}? {reply}."), (2, ask)], "item_id int, item_text string")
    df = spark.createDataFrame([(1, f"Pre {ask}; post"), (2, f"x {reply} y"), (3, f"{ask} - {reply}")], "doc_id int, text string")
    got = {(r.doc_id, r.item_id): r for r in leaked_items(df, it).collect()}
    assert (got[1, 1].question_share, got[1, 1].answer_share) == (1.0, 0.0) and (got[2, 1].question_share, got[2, 1].answer_share) == (0.0, 1.0)
    assert got[3, 1].item_share == 1.0 and got[3, 1].longest_run == len(f"{ask} {reply}".split()) and got[1, 2].answer_share is None


def test_words():
    assert words("The ﬁlter-\nhousing vex\xadgarvex, STRASSE/Straße 6.8") == ["the", "filterhousing", "vexgarvex", "strasse", "strasse", "6", "8"]
    assert words("well-\nknown a", {"well", "known"}) == ["well", "known", "a"] and words("pli-\nnav-\ntov") == ["plinavtov"]
    assert words("well-\nknown, over-\n  all", {"well", "known", "over", "all", "overall"}) == ["well", "known", "overall"]
    assert words(None) == words("") == words("-- ...") == []


def test_poisson():
    for rate in (0.1, 1.0, 5.0):
        for cap in (1, 3, 8):
            p = [math.exp(-rate) * rate**k / math.factorial(k) for k in range(80)]
            assert abs(capped_mean(rate, cap) - sum(min(k, cap) * q for k, q in enumerate(p))) < 1e-9
            assert abs(cumulative(rate, cap)[-1] - sum(p[:cap])) < 1e-9
    assert abs(capped_mean(solved_rate(150.0, [(100.0, 3)]), 3) - 1.5) < 1e-6 and solved_rate(300.0, [(100.0, 3)]) == math.inf


def test_mix(spark):
    rnd = random.Random(1)
    docs = [(i, s, f"k{i}", rnd.randint(1, 400), "x") for i in range(6000) for s in [rnd.choices(["a", "b", "c", "none"], [70, 20, 9, 1])[0]]]
    docs += [(9000 + i, "b", "same", 50, "x") for i in range(30)] + [(9999, None, "kk", 5, "x"), (9998, "a", "zero", 0, "x"), (1, "a", "k1", 7, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text_key string, n_tokens bigint, copy string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("empty", 0.1, 3), (None, 0.4, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixed(df, targets, seed=3)
    rows = mix.collect()
    shares = {r.source: r for r in report.collect()}
    assert set(shares) == {"a", "b", "c", "empty"} and shares["empty"].n_tokens == 0
    assert all(abs(shares[s].actual_share - t) < 0.01 for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert shares["a"].most_copies == 1 and shares["b"].most_copies <= 2 and shares["c"].most_copies <= 4
    assert len({r.doc_id for r in rows if r.doc_id >= 9000}) <= 1 and len(rows) == sum(r.n_copies for r in shares.values())
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert sorted(map(tuple, mixed(df, targets, seed=3)[0].collect())) == sorted(map(tuple, rows))
    assert mixed(df.where("false"), targets)[0].count() == 0 and mixed(df, targets.where("false"))[1].count() == 0
    small = mixed(df, targets, total=20000)[1].collect()
    assert abs(sum(r.n_tokens for r in small) - 20000) < 600


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 100_000)], "n int, text string")
    got = {r.n: r.n_tokens for r in with_tokens(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000


COMMON = Common([("en", w) for w in "the of and a to in is that for it as was with be by on not he his but at are this have from or had an they which".split()])
PROSE = "The valve is opened by hand, which is slow, and the load on the lever is shared. It was found that the rod can be heated. "


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE * 1, "prose"), (PROSE * 9, "junk"), ("", "prose"), ("\n\n", "prose"), ("* pump\n* valve\n* rod\n* lever\n", "list"), ("12 rod\n13 cap\n14 pin\n15 lid", "list"),
        ("Claims\n\n1. A valve that is opened by hand and closed\nby a rod.\n\n2. The valve of claim 1 that is heated in\nthe shaft.\n\n3. The valve of claim 2, in which the rod is\nbent.", "prose"),
        ("[1] XQ 11 A1\n[2] XQ 12 B1\n[3] XQ 13 B1\n", "list"), ("rod (12); cap (13); pin (14); lid (15); nut (16); bolt (17)", "list"), ("B65G 25/2389\nC08L 9/876\nB23K 44/9166\nF16K 45/251", "list"),
        ("name\tsize\nrod\t5\ncap\t6", "table"), ("| a | b |\n|---|---|\n| 1 | 2 |", "table"), ("a      b      c\n------------\n1      2      3", "table"), ("rod;cap;pin\nEx. 1;3;4\nEx. 2;-;7", "table"),
        ("left blank\n" * 8, "junk"), (" ".join("".join("qzrtvbnmxkplwghsdfcj"[(i * k + k) % 20] for k in range(3, 9)) for i in range(40)), "junk"), ("Ã¤hnliche RÃ¤der drÃ¼cken fÃ¼r lÃ¤ngere LÃ¶sungen gegen Ã¶lige BÃ¼chsen", "junk"), ("acfhFJbgNu59WNDwa2JGctfEEs93apk6gO2/413nLFK3eLbm+8dUuPRfRoEcAXKjQAlaSQ05Dm8W", "junk"),
        ("............ 12 ______\n....... 14 ____\n......... 15 _____", "junk"), ("of rod be the an his cap it to pin from as lid not by at nut but are on was with in is and bolt that for had which they or this a have he seal flange core gear", "junk"),
        (PROSE + "\n\n* rod\n* cap\n* pin\n", "prose"),
    ],
)
def test_kinds(text, kind):
    got = described(text, COMMON)
    assert got["text_kind"] == kind, got
    assert all(0 <= got[k] <= 1 for k in got if k.endswith(("share", "ratio", "words", "lines")) and k != "n_words")


SCRIPTS = {
    "Cyrillic": "Клапан открывают вручную, что занимает много времени. Нагрузка на рычаг распределяется между двумя опорами. При нагреве стержень удлиняется, и зазор исчезает. Поэтому его делают из другого сплава.",
    "Greek": "Η βαλβίδα ανοίγει με το χέρι, πράγμα που παίρνει πολύ χρόνο. Το φορτίο του μοχλού μοιράζεται σε δύο στηρίγματα. Όταν η ράβδος θερμαίνεται, το διάκενο εξαφανίζεται. Γι' αυτό κατασκευάζεται από άλλο κράμα.",
    "Arabic": "يفتح الصمام باليد، وهذا يستغرق وقتا طويلا. يتوزع الحمل على الذراع بين دعامتين. عندما يسخن القضيب يختفي الخلوص، فهل يكفي ذلك؟ لذلك يصنع من سبيكة أخرى لا تتمدد كثيرا مع الحرارة.",
    "Hebrew": "השסתום נפתח ביד, וזה לוקח זמן רב. העומס על המנוף מתחלק בין שתי תמיכות. כאשר המוט מתחמם הרווח נעלם. לכן הוא עשוי מסגסוגת אחרת שאינה מתפשטת הרבה עם החום.",
    "Devanagari": "वाल्व को हाथ से खोला जाता है, जिसमें बहुत समय लगता है। भार दो सहारों के बीच बँट जाता है। जब छड़ गर्म होती है तो अंतर समाप्त हो जाता है। इसलिए इसे दूसरी मिश्रधातु से बनाया जाता है जो कम फैलती है।",
    "Thai": "วาล์วถูกเปิดด้วยมือซึ่งใช้เวลานาน น้ำหนักบนคันโยกถูกแบ่งระหว่างฐานรองสองจุด เมื่อแท่งร้อนขึ้น ช่องว่างก็หายไป ดังนั้นจึงทำจากโลหะผสมชนิดอื่น ที่ขยายตัวน้อยกว่าเมื่อได้รับความร้อน",
    "Han": "阀门由手动打开，这需要很长时间。杠杆上的载荷由两个支座分担。当杆受热时，间隙消失。因此它由另一种合金制成，这种合金在受热时膨胀较小。",
    "Kana": "弁は手で開かれるため、時間がかかる。レバーにかかる荷重は二つの支持部で分担される。棒が加熱されると、すき間がなくなる。そのため、熱による膨張が小さい別の合金で作られている。",
    "Hangul": "밸브는 손으로 열기 때문에 시간이 오래 걸린다. 레버에 걸리는 하중은 두 개의 지지대가 나누어 받는다. 막대가 가열되면 틈이 사라진다. 그래서 열에 덜 팽창하는 다른 합금으로 만든다.",
    "Georgian": "სარქველი იხსნება ხელით, რასაც დიდი დრო სჭირდება. ბერკეტზე დატვირთვა ორ საყრდენს შორის ნაწილდება. როცა ღერო ცხელდება, ღრეჩო ქრება. ამიტომ იგი სხვა შენადნობისგან მზადდება.",
    "Tamil": "வால்வு கையால் திறக்கப்படுகிறது, இதற்கு அதிக நேரம் ஆகும். சுமை இரண்டு தாங்கிகளுக்கு இடையே பகிரப்படுகிறது. தண்டு சூடாகும்போது இடைவெளி மறைகிறது. எனவே இது வேறு உலோகக் கலவையால் செய்யப்படுகிறது.",
    "Vietnamese": "Van được mở bằng tay, việc này mất nhiều thời gian. Tải trọng trên đòn bẩy được chia cho hai gối đỡ. Khi thanh nóng lên, khe hở biến mất. Vì vậy nó được làm bằng một hợp kim khác.",
    "Polish": "Zawór otwiera się ręcznie, co zajmuje dużo czasu. Obciążenie dźwigni rozkłada się na dwie podpory. Gdy pręt się nagrzewa, szczelina znika. Dlatego wykonuje się go z innego stopu.",
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_prose_of_any_script(script):
    text = SCRIPTS[script]
    for t in (text, text.replace(". ", ".\n").replace("。", "。\n").replace("। ", "।\n"), f"Title\n\n{text}\n\n(12) {text[:60]}"):
        got = described(t, COMMON)
        assert got["text_kind"] == "prose" and got["junk_share"] < 0.1, got


def test_repetition():
    page = "Filed under the rules of the office.\nSheet of the record, kept by hand.\n"
    assert described(page * 2 + "An end.", COMMON)["text_kind"] == "boilerplate" and described(page * 5, COMMON)["text_kind"] == "junk"
    assert described("to the rod " * 40, COMMON)["text_kind"] == "junk" and described("*** ### " * 30, COMMON)["text_kind"] == "junk"
    many = Common([(f"l{i}", w) for i in range(9) for w in ("the", "w" + chr(97 + i))])
    assert described("the wd is we we here", many)["common_words"] == 0.5


def test_quality(spark):
    df = spark.createDataFrame([(1, PROSE, "x"), (1, PROSE, "y"), (2, None, "x"), (3, "", "x"), (4, "word " * 50_000, "x")], "doc_id int, text string, text_kind string")
    common = spark.createDataFrame([("en", "the"), ("en", "is"), ("de", "ist"), (None, "x")], "lang string, word string")
    got = sorted(((r.doc_id, r.text_kind, r.n_words) for r in text_quality(df, common).collect()), key=str)
    assert got[:2] == [(1, "prose", 26)] * 2 and got[2] == (2, None, None) and got[3] == (3, "prose", 0) and got[4][2] == 50_000
    assert text_quality(df.where("false"), common).count() == 0
