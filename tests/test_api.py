"""The compiler without Spark."""

import subprocess
import sys

import pytest

import markloom


def test_documents():
    assert markloom.to_html("# a") == '<h1 id="a">a</h1>\n'
    assert markloom.to_html("a | b", "minimal") == "<p>a | b</p>\n"
    assert markloom.transform("+++\nx\n+++\n# A", {"frontMatter": True}) == {"html": '<h1 id="a">A</h1>\n', "headings": [{"level": 1, "id": "a", "text": "A"}], "frontMatter": "x\n"}
    assert "frontMatter" not in markloom.transform("x")
    assert markloom.parse("---\na\n---\nx").front_matter == "a\n"
    assert markloom.source_location("é\nab", 4) == (2, 2)


def test_events():
    assert [e["kind"] for e in markloom.block_events("- a")] == ["ListStart", "ListItemStart", "ParagraphStart", "Text", "ParagraphEnd", "ListItemEnd", "ListEnd"]
    assert [e["kind"] for e in markloom.inline_events("*a* `b`")] == ["EmphasisStart", "Text", "EmphasisEnd", "Text", "Code"]


def test_mdx():
    assert [s.kind for s in markloom.mdx_segments("<A>\nx\n</A>\n", strict=True)] == ["JsxBlockOpen", "Markdown", "JsxBlockClose"]
    with pytest.raises(ValueError):
        markloom.mdx_segments("<A>", strict=True)
    assert markloom.mdx_render("<A>\n\nx\n").body == "<A>\n<p>x</p>\n"


def test_command(tmp_path):
    (tmp_path / "a.md").write_text("*é*")
    for args, given in (([str(tmp_path / "a.md")], None), (["-"], "*é*".encode())):
        out = subprocess.run([sys.executable, "-m", "markloom", *args], input=given, capture_output=True, cwd=str(markloom.__path__[0]) + "/..", timeout=60)
        assert out.stdout.decode() == "<p><em>é</em></p>\n"
