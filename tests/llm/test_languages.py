"""The byte network against nested loops and finite differences, and texts in scripts that nobody taught."""

import random

import numpy as np
import pyarrow as pa
import pytest

from markloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string"
FOREIGN = [
    "Москва является столицей России и крупнейшим городом страны.", "これは日本語の文章です。東京は日本の首都であり、多くの人が住んでいます。", "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας.", "北京是中华人民共和国的首都，也是全国的政治中心。",
    "هذا نص مكتوب باللغة العربية عن مدينة كبيرة", "서울은 대한민국의 수도이다 그리고 큰 도시이다", "กรุงเทพเป็นเมืองหลวงของประเทศไทย", "ירושלים היא עיר גדולה ועתיקה מאוד", "यह हिन्दी में लिखा हुआ एक वाक्य है",
]


def taught(n=160, seed=1):
    rng = random.Random(seed)
    words = {"de": "der die und schön größe nicht ein zug über haus straße mit von".split(), "en": "the of and with this thing shall be house street from other".split(), "fr": "le la été où garçon rue maison avec être une très ville".split()}
    return [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 120))), lang, "s") for k in range(n) for lang in [rng.choice(sorted(words))]]


@pytest.fixture(scope="module")
def net():
    rows = taught()
    others = langid.foreign([r[1] for r in rows], 12)
    return langid.fit([r[1] for r in rows] + others, [r[2] for r in rows] + [None] * len(others))


def test_probabilities_by_nested_loops(net):
    """Each filter at each place, byte by byte; a filter of width w uses w of the offsets."""
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    windows[1, 40:] = 0
    deep, _, n_filters = net.tables.shape
    width = np.repeat(langid.WIDTHS, langid.FILTERS)
    for row, found in zip(windows, net.probabilities(windows)):
        best = np.full(n_filters, -np.inf)
        for f in range(n_filters):
            assert not net.tables[width[f] :, :, f].any()
            for at in range(langid.WINDOW - deep + 1):
                best[f] = max(best[f], sum(float(net.tables[j, row[at + j], f]) for j in range(width[f])))
        z = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(found, want, atol=1e-4) and found.argmax() == want.argmax()


def test_texts_are_the_mean_of_their_windows(net):
    texts = [taught(1, k)[0][1] * 9 for k in range(4)] + ["é" * 200_000 + " the end"]
    for t, lang, score, known in zip(texts, *langid.decide(pa.array(texts), net)):
        raw = t.encode()
        total = np.zeros(len(net.langs) + 1)
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            total += len(part) * net.probabilities(np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)[None])[0]
        total /= len(raw)
        assert lang == net.langs[total[:-1].argmax()] and abs(score - total[:-1].max()) < 1e-4 and abs(known - total[:-1].sum()) < 1e-4


def test_untaught_scripts_go_and_taught_languages_stay(spark):
    rows = taught() + [(1000 + k, t, None, "s") for k, t in enumerate(FOREIGN)] + [(2000, "the", None, "s"), (2001, "größe", None, "s"), (2002, "", "en", "s"), (2003, None, "en", "s"), (2004, "Привет the house of this street and other thing with this house from the street", None, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs.where(~langid.held_out()))
    kept = {r["doc_id"] for r in langid.accepted(docs, model).collect()}
    assert kept == set(range(160)) | {2000, 2001, 2004}
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} <= {"de", "en", "fr", "und"}


def test_a_taught_script_is_not_foreign():
    texts = ["Москва столица России"] * 20
    assert not any("А" <= c <= "я" for t in langid.foreign(texts) for c in t) and any("А" <= c <= "я" for t in langid.foreign(["plain"]) for c in t)
