"""Documents compiled in parts against the same compiled whole."""

import hashlib
import random

import pytest

from markloom.kernel import parts as K
from markloom.kernel.options import options
from markloom.kernel.render import to_html
from markloom.kernel.text import front_matter
from markloom.plans import parts

BLOCKS = [
    "Plain [a] text [b][C] and ![i][a].", "# Same *h*", "## Same h", "Same h\n---", "- x\n\n  y\n- z [^n]", "1. one\n\n       code", "> q\n> [a\n> b] lazy\nmore", "```py\nx\n\nLetters here\n\n# not a heading\n```", "~~~~\n```\n\nA\n~~~~",
    "<!-- c\n\nText in it\n\n# more -->", "<script>\n\nlet x\n\n</script> after", "<div>\n\nin *div*\n\n</div>", "[a]: /a 'T'", "[A]: /later", "[c]: /c\n[a b]: /ab", "[^n]: note [a]\n\n    more `x`", "[^N]: second", "[^m]: other[^n]", "Ref[^m] and[^n] and[^m] [^zz]",
    "a|b\n-|-\n[a]|x\\|y [c]", "    indented\n\n    code", "term\n: about [a]\n\nterm two\n\n: loose", "   ```\n   deep\n\nOut\n   ```", "- ```\n  in item\n\nEnds it", "> [!NOTE]\n> note [^m]", "***", "é \0 <b> & \"q\" [c]", "#nohead",
]
OPTIONS = [None, {"footnotes": True}, {"footnotes": True, "definitionLists": True, "renderPolicy": "trusted", "frontMatter": True}, "commonmark", {"footnotes": True, "headingIds": False, "allowHtml": False, "lineComments": True}]


def document(rng, n=40):
    text = "\n\n".join(rng.choice(BLOCKS) + rng.choice(["", "\n", "  "]) for _ in range(rng.randint(0, n)))
    return rng.choice(["", "\n", "+++\nx = 1\n+++\n"]) + text + rng.choice(["", "\n", "\n```\n\nOpen end", "\n\n<!-- open\n\nEnd", "\n\n"])


def test_cuts_are_whole():
    rng = random.Random(1)
    for _ in range(60):
        s = document(rng)
        assert "".join(K.cut(s, 10)) == s
    assert K.resume("x\n```` \nnext", "```") == 8 and K.resume("x\n``\n", "```") is None and K.resume("a --> b\nc", "1") == 8 and K.resume("``` x\n```", "```") == 9


@pytest.mark.parametrize("which", range(len(OPTIONS)))
def test_parts_are_the_whole(spark, which):
    rng = random.Random(which)
    texts = [document(rng) for _ in range(40)] + ["", None, "one", "\n", "A\n\nB\n\nC"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    opts = options(OPTIONS[which])
    found = {}
    for r in parts.compiled(docs, opts, size=25).orderBy("doc_id", "part").collect():
        found.setdefault(r["doc_id"], []).append(r["html"])
    whole = lambda t: to_html(front_matter(t)[1] if opts.front_matter else t, opts.with_(front_matter=False))
    for k, t in enumerate(texts):
        if t is None:
            assert found[k] == [None]
        else:
            assert "".join(found[k]) == whole(t), repr(t)
    assert max(map(len, found.values())) > (4 if opts.definition_lists else 10)


def test_inline_notes_are_compiled_whole(spark):
    docs = spark.createDataFrame([(1, "a^[b]\n\nC\n\nD")], "doc_id long, text string")
    opts = options({"inlineFootnotes": True, "footnotes": True})
    assert [r["html"] for r in parts.compiled(docs, opts, size=2).collect()] == [to_html("a^[b]\n\nC\n\nD", opts)]


def test_a_long_document(spark):
    """Five million characters in many parts, with definitions at the far end, and one fence over many cuts."""
    body = "".join(f"# Head\n\nSome *text* number {k} with [link][r] and[^n{k % 9}].\n\n" for k in range(50_000))
    text = body + "```\n" + "Line\n\nWord\n\n" * 50_000 + "```\n\n[r]: /r\n\n" + "\n\n".join(f"[^n{k}]: note {k}" for k in range(9)) + "\n"
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    rows = parts.compiled(docs, {"footnotes": True}, size=100_000).orderBy("part").collect()
    assert len(rows) > 30 and "".join(r["html"] for r in rows) == to_html(text, options({"footnotes": True}))


def test_documents_in_rows(spark):
    """Documents that stand in rows are never one string; parts and digests are those of the whole."""
    rows = [(d, k, f"# Head\n\nText {k} é [l][r] and[^n{k % 3}].\n\n") for d in (1, 2) for k in range(200 * d)]
    rows += [(d, 1000, "[r]: /r\n\n" + "".join(f"[^n{k}]: note {k}\n\n" for k in range(3))) for d in (1, 2)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, seq long, text string")
    done = parts.compiled(docs, {"footnotes": True}, size=500, order="seq")
    found = {r["doc_id"]: (r["n_chars"], r["html_md5"]) for r in parts.digests(done).collect()}
    for d in (1, 2):
        html = to_html("".join(x[2] for x in rows if x[0] == d), options({"footnotes": True}))
        assert found[d] == (len(html), hashlib.md5(html.encode()).hexdigest())
    assert done.count() > 20
