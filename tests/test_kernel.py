"""Documents and the HTML they compile to."""

import random

import pytest

from markloom.kernel import events, mdx
from markloom.kernel import text as T
from markloom.kernel.options import COMMONMARK, DEFAULT, GFM, MDX, MINIMAL, options
from markloom.kernel.render import compile_document, to_html

TRUSTED = COMMONMARK.with_(render_policy="trusted")


def of(**more):
    return DEFAULT.with_(**more)


TERMS, NOTES = of(definition_lists=True), of(footnotes=True)
INLINE_NOTES = of(footnotes=True, inline_footnotes=True, superscript=True)
MERGED, COMMENTS = of(merged_table_cells=True), of(line_comments=True)

#: Examples of the CommonMark specification 0.31 (John MacFarlane, CC BY-SA 4.0), whose HTML is given there.
COMMON = [
("\tfoo\tbaz\t\tbim\n","<pre><code>foo\tbaz\t\tbim\n</code></pre>\n"),
("  - foo\n\n\tbar\n","<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"),
("- foo\n\n\t\tbar\n","<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>\n"),
(">\t\tfoo\n","<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>\n"),
("-\t\tfoo\n","<ul>\n<li>\n<pre><code>  foo\n</code></pre>\n</li>\n</ul>\n"),
(" - foo\n   - bar\n\t - baz\n","<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>baz</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n"),
("#\tFoo\n","<h1>Foo</h1>\n"),("*\t*\t*\t\n","<hr />\n"),
("- `one\n- two`\n","<ul>\n<li>`one</li>\n<li>two`</li>\n</ul>\n"),
("- foo\n***\n- bar\n","<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>\n"),
("Foo\n***\nbar\n","<p>Foo</p>\n<hr />\n<p>bar</p>\n"),("Foo\n---\nbar\n","<h2>Foo</h2>\n<p>bar</p>\n"),
("* Foo\n* * *\n* Bar\n","<ul>\n<li>Foo</li>\n</ul>\n<hr />\n<ul>\n<li>Bar</li>\n</ul>\n"),
("- Foo\n- * * *\n","<ul>\n<li>Foo</li>\n<li>\n<hr />\n</li>\n</ul>\n"),
("## foo ##\n  ###   bar    ###\n","<h2>foo</h2>\n<h3>bar</h3>\n"),("# foo#\n","<h1>foo#</h1>\n"),("### foo \\###\n","<h3>foo ###</h3>\n"),
("## \n#\n### ###\n","<h2></h2>\n<h1></h1>\n<h3></h3>\n"),
("Foo *bar\nbaz*\n====\n","<h1>Foo <em>bar\nbaz</em></h1>\n"),("Foo\n    ---\n","<p>Foo\n---</p>\n"),
("> Foo\n---\n","<blockquote>\n<p>Foo</p>\n</blockquote>\n<hr />\n"),("> foo\nbar\n===\n","<blockquote>\n<p>foo\nbar\n===</p>\n</blockquote>\n"),
("- Foo\n---\n","<ul>\n<li>Foo</li>\n</ul>\n<hr />\n"),("> foo\n-----\n","<blockquote>\n<p>foo</p>\n</blockquote>\n<hr />\n"),
("    chunk1\n\n    chunk2\n  \n \n \n    chunk3\n","<pre><code>chunk1\n\nchunk2\n\n\n\nchunk3\n</code></pre>\n"),
("Foo\n    bar\n","<p>Foo\nbar</p>\n"),("```\naaa\n~~~\n```\n","<pre><code>aaa\n~~~\n</code></pre>\n"),
("> ```\n> aaa\n\nbbb\n","<blockquote>\n<pre><code>aaa\n</code></pre>\n</blockquote>\n<p>bbb</p>\n"),
("```ruby startline=3 $%@#$\ndef\n```","<pre><code class=\"language-ruby\">def\n</code></pre>\n"),
("<table><tr><td>\n<pre>\n**Hello**,\n\n_world_.\n</pre>\n</td></tr></table>\n","<table><tr><td>\n<pre>\n**Hello**,\n<p><em>world</em>.\n</pre></p>\n</td></tr></table>\n"),
("[foo]: /url \"title\"\n\n[foo]\n","<p><a href=\"/url\" title=\"title\">foo</a></p>\n"),
("   [foo]: \n      /url  \n           'the title'  \n\n[foo]\n","<p><a href=\"/url\" title=\"the title\">foo</a></p>\n"),
("[Foo*bar\\]]:my_(url) 'title (with parens)'\n\n[Foo*bar\\]]\n","<p><a href=\"my_(url)\" title=\"title (with parens)\">Foo*bar]</a></p>\n"),
("[foo]: /url \"title\" ok\n","<p>[foo]: /url &quot;title&quot; ok</p>\n"),
("[foo]: /url\n\"title\" ok\n","<p>&quot;title&quot; ok</p>\n"),
("> # Foo\n> bar\n> baz\n","<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>\n"),
("> - foo\n- bar\n","<blockquote>\n<ul>\n<li>foo</li>\n</ul>\n</blockquote>\n<ul>\n<li>bar</li>\n</ul>\n"),
(">     foo\n    bar\n","<blockquote>\n<pre><code>foo\n</code></pre>\n</blockquote>\n<pre><code>bar\n</code></pre>\n"),
("> > > foo\nbar\n","<blockquote>\n<blockquote>\n<blockquote>\n<p>foo\nbar</p>\n</blockquote>\n</blockquote>\n</blockquote>\n"),
("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.\n","<ol>\n<li>\n<p>A paragraph\nwith two lines.</p>\n<pre><code>indented code\n</code></pre>\n<blockquote>\n<p>A block quote.</p>\n</blockquote>\n</li>\n</ol>\n"),
("- one\n\n two\n","<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n"),
("- foo\n\n\n  bar\n","<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"),
("-\n\n  foo\n","<ul>\n<li></li>\n</ul>\n<p>foo</p>\n"),("- foo\n-\n- bar\n","<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>\n"),
("-\n  foo\n-\n  ```\n  bar\n  ```\n","<ul>\n<li>foo</li>\n<li>\n<pre><code>bar\n</code></pre>\n</li>\n</ul>\n"),
("foo\n*\n\nfoo\n1.\n","<p>foo\n*</p>\n<p>foo\n1.</p>\n"),
("- a\n - b\n  - c\n   - d\n    - e\n","<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d\n- e</li>\n</ul>\n"),
("- foo\n- bar\n\n\n- baz\n","<ul>\n<li>\n<p>foo</p>\n</li>\n<li>\n<p>bar</p>\n</li>\n<li>\n<p>baz</p>\n</li>\n</ul>\n"),
("- foo\n  - bar\n    - baz\n\n\n      bim\n","<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>\n<p>baz</p>\n<p>bim</p>\n</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n"),
("- a\n- b\n\n  [ref]: /url\n- d\n","<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>d</p>\n</li>\n</ul>\n"),
("- a\n  - b\n\n    c\n- d\n","<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),
("* a\n  > b\n  >\n* c\n","<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n</li>\n<li>c</li>\n</ul>\n"),
("- a\n  > b\n  ```\n  c\n  ```\n- d\n","<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n<pre><code>c\n</code></pre>\n</li>\n<li>d</li>\n</ul>\n"),
("* foo\n  * bar\n\n  baz\n","<ul>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n<p>baz</p>\n</li>\n</ul>\n"),
("- a\n  - b\n  - c\n\n- d\n  - e\n  - f\n","<ul>\n<li>\n<p>a</p>\n<ul>\n<li>b</li>\n<li>c</li>\n</ul>\n</li>\n<li>\n<p>d</p>\n<ul>\n<li>e</li>\n<li>f</li>\n</ul>\n</li>\n</ul>\n"),
("- a\n- ```\n  b\n\n\n  ```\n- c\n","<ul>\n<li>a</li>\n<li>\n<pre><code>b\n\n\n</code></pre>\n</li>\n<li>c</li>\n</ul>\n"),
("* a\n*\n\n* c\n","<ul>\n<li>\n<p>a</p>\n</li>\n<li></li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"),
("`` foo ` bar ``\n","<p><code>foo ` bar</code></p>\n"),("*foo`*`\n","<p>*foo<code>*</code></p>\n"),("`foo   bar \nbaz`\n","<p><code>foo   bar  baz</code></p>\n"),
("**foo*bar**\n","<p><strong>foo*bar</strong></p>\n"),("*foo**bar**baz*\n","<p><em>foo<strong>bar</strong>baz</em></p>\n"),("foo***bar***baz\n","<p>foo<em><strong>bar</strong></em>baz</p>\n"),
("***foo** bar*\n","<p><em><strong>foo</strong> bar</em></p>\n"),("*foo **bar***\n","<p><em>foo <strong>bar</strong></em></p>\n"),("__foo_bar_baz__\n","<p><strong>foo_bar_baz</strong></p>\n"),
("*foo [bar*](/url)\n","<p>*foo <a href=\"/url\">bar*</a></p>\n"),("[link](<foo\nbar>)\n","<p>[link](<foo\nbar>)</p>\n"),("[a](<b)c>)\n","<p><a href=\"b)c\">a</a></p>\n"),
("[link](foo\\bar)\n","<p><a href=\"foo%5Cbar\">link</a></p>\n"),("[link](foo%20b&auml;)\n","<p><a href=\"foo%20b%C3%A4\">link</a></p>\n"),("[link](\"title\")\n","<p><a href=\"%22title%22\">link</a></p>\n"),
("[foo [bar](/uri)](/uri)\n","<p>[foo <a href=\"/uri\">bar</a>](/uri)</p>\n"),("![[[foo](uri1)](uri2)](uri3)\n","<p><img src=\"uri3\" alt=\"[foo](uri2)\" /></p>\n"),
("[foo][bar][baz]\n\n[baz]: /url1\n[bar]: /url2\n","<p><a href=\"/url2\">foo</a><a href=\"/url1\">baz</a></p>\n"),("[foo] \n[]\n\n[foo]: /url \"title\"\n","<p><a href=\"/url\" title=\"title\">foo</a>\n[]</p>\n"),
("![foo *bar*][]\n\n[foo *bar*]: train.jpg \"train & tracks\"\n","<p><img src=\"train.jpg\" alt=\"foo bar\" title=\"train &amp; tracks\" /></p>\n"),
("<http://foo.bar.baz/test?q=hello&id=22&boolean>\n","<p><a href=\"http://foo.bar.baz/test?q=hello&amp;id=22&amp;boolean\">http://foo.bar.baz/test?q=hello&amp;id=22&amp;boolean</a></p>\n"),
("foo <!-- this is a --\ncomment - with hyphens -->\n","<p>foo <!-- this is a --\ncomment - with hyphens --></p>\n"),("foo  \n     bar\n","<p>foo<br />\nbar</p>\n"),("foo\\\nbar\n","<p>foo<br />\nbar</p>\n"),("&nbsp; &amp; &copy; &#35; &#0; &x;\n","<p>\u00a0 &amp; © # \ufffd &amp;x;</p>\n"),
("**Gomphocarpus (*Gomphocarpus physocarpus*, syn.\n*Asclepias physocarpa*)**\n","<p><strong>Gomphocarpus (<em>Gomphocarpus physocarpus</em>, syn.\n<em>Asclepias physocarpa</em>)</strong></p>\n"),
("*foo*bar\n***a** b **c***\n","<p><em>foo</em>bar\n<em><strong>a</strong> b <strong>c</strong></em></p>\n"),
("10) foo\n   - bar\n","<ol start=\"10\">\n<li>foo</li>\n</ol>\n<ul>\n<li>bar</li>\n</ul>\n"),
("1. > Blockquote\ncontinued here.\n","<ol>\n<li>\n<blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote>\n</li>\n</ol>\n"),
("- # Foo\n- Bar\n  ---\n  baz\n","<ul>\n<li>\n<h1>Foo</h1>\n</li>\n<li>\n<h2>Bar</h2>\nbaz</li>\n</ul>\n"),
]
#: More of them, with other options or deeper nesting.
MORE = [
("*(*foo*)*\n","<p><em>(<em>foo</em>)</em></p>\n"),("**foo \"*bar*\" foo**\n","<p><strong>foo &quot;<em>bar</em>&quot; foo</strong></p>\n"),
("foo******bar*********baz\n","<p>foo<strong><strong><strong>bar</strong></strong></strong>***baz</p>\n"),
("[foo]: /url\n===\n[foo]\n","<p>===\n<a href=\"/url\">foo</a></p>\n"),("[foo]: /url\nbar\n===\n[foo]\n","<h1>bar</h1>\n<p><a href=\"/url\">foo</a></p>\n"),
("[foo]: <bar>(baz)\n\n[foo]\n","<p>[foo]: <bar>(baz)</p>\n<p>[foo]</p>\n"),("[foo]:\n\n[foo]\n","<p>[foo]:</p>\n<p>[foo]</p>\n"),
("[foo]: /url '\ntitle\nline1\nline2\n'\n\n[foo]\n","<p><a href=\"/url\" title=\"\ntitle\nline1\nline2\n\">foo</a></p>\n"),
("[foo]\n\n> [foo]: /url\n","<p><a href=\"/url\">foo</a></p>\n<blockquote>\n</blockquote>\n"),
("[foo]: /foo-url \"foo\"\n[bar]: /bar-url\n  \"bar\"\n[baz]: /baz-url\n\n[foo],\n[bar],\n[baz]\n","<p><a href=\"/foo-url\" title=\"foo\">foo</a>,\n<a href=\"/bar-url\" title=\"bar\">bar</a>,\n<a href=\"/baz-url\">baz</a></p>\n"),
("1. a\n\n  2. b\n\n    3. c\n","<ol>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ol>\n<pre><code>3. c\n</code></pre>\n"),
("- a\n\n- b\n\n\n- c\n","<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"),
("- foo\n- bar\n+ baz\n","<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<ul>\n<li>baz</li>\n</ul>\n"),
("The number of windows in my house is\n14.  The number of doors is 6.\n","<p>The number of windows in my house is\n14.  The number of doors is 6.</p>\n"),
("- foo\n\n<!-- -->\n\n    code\n","<ul>\n<li>foo</li>\n</ul>\n<!-- -->\n<pre><code>code\n</code></pre>\n"),
("> foo\n\n> bar\n","<blockquote>\n<p>foo</p>\n</blockquote>\n<blockquote>\n<p>bar</p>\n</blockquote>\n"),(">\n> foo\n>  \n","<blockquote>\n<p>foo</p>\n</blockquote>\n"),
("> bar\n\nbaz\n","<blockquote>\n<p>bar</p>\n</blockquote>\n<p>baz</p>\n"),("> 1. > Blockquote\ncontinued here.\n","<blockquote>\n<ol>\n<li>\n<blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote>\n</li>\n</ol>\n</blockquote>\n"),
("   > > 1.  one\n>>\n>>     two\n","<blockquote>\n<blockquote>\n<ol>\n<li>\n<p>one</p>\n<p>two</p>\n</li>\n</ol>\n</blockquote>\n</blockquote>\n"),
(">>- one\n>>\n  >  > two\n","<blockquote>\n<blockquote>\n<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n</blockquote>\n</blockquote>\n"),
("-one\n\n2.two\n","<p>-one</p>\n<p>2.two</p>\n"),("- foo\n\n      bar\n","<ul>\n<li>\n<p>foo</p>\n<pre><code>bar\n</code></pre>\n</li>\n</ul>\n"),
("1.     indented code\n\n   paragraph\n\n       more code\n","<ol>\n<li>\n<pre><code>indented code\n</code></pre>\n<p>paragraph</p>\n<pre><code>more code\n</code></pre>\n</li>\n</ol>\n"),
("- \n  foo\n","<ul>\n<li>foo</li>\n</ul>\n"),("*\n","<ul>\n<li></li>\n</ul>\n"),("-    foo\n\n  bar\n","<ul>\n<li>foo</li>\n</ul>\n<p>bar</p>\n"),
("- - foo\n","<ul>\n<li>\n<ul>\n<li>foo</li>\n</ul>\n</li>\n</ul>\n"),("1. - 2. foo\n","<ol>\n<li>\n<ul>\n<li>\n<ol start=\"2\">\n<li>foo</li>\n</ol>\n</li>\n</ul>\n</li>\n</ol>\n"),
("<div>\n*foo*\n\n*bar*\n","<div>\n*foo*\n<p><em>bar</em></p>\n"),("<style\n  type=\"text/css\">\nh1 {color:red;}\n\np {color:blue;}\n</style>\nokay\n","<style\n  type=\"text/css\">\nh1 {color:red;}\n\np {color:blue;}\n</style>\n<p>okay</p>\n"),
("Foo\n<div>\nbar\n</div>\n","<p>Foo</p>\n<div>\nbar\n</div>\n"),("Foo\n<a href=\"bar\">\nbaz\n","<p>Foo\n<a href=\"bar\">\nbaz</p>\n"),("<del>\n*foo*\n</del>\n","<del>\n*foo*\n</del>\n"),("<del>*foo*</del>\n","<p><del><em>foo</em></del></p>\n"),
("<!-- foo -->*bar*\n*baz*\n","<!-- foo -->*bar*\n<p><em>baz</em></p>\n"),("  <div>\n\n    <div>\n","  <div>\n<pre><code>&lt;div&gt;\n</code></pre>\n"),
("~~~~    ruby startline=3 $%@#$\ndef foo(x)\n  return 3\nend\n~~~~~~~\n","<pre><code class=\"language-ruby\">def foo(x)\n  return 3\nend\n</code></pre>\n"),("``` ```\naaa\n","<p><code> </code>\naaa</p>\n"),("~~~ aa ``` ~~~\nfoo\n~~~\n","<pre><code class=\"language-aa\">foo\n</code></pre>\n"),
("   ```\n   aaa\n    aaa\n  aaa\n   ```\n","<pre><code>aaa\n aaa\naaa\n</code></pre>\n"),("foo\n```\nbar\n```\nbaz\n","<p>foo</p>\n<pre><code>bar\n</code></pre>\n<p>baz</p>\n"),
("[link](/url \"title \\\"&quot;\")\n","<p><a href=\"/url\" title=\"title &quot;&quot;\">link</a></p>\n"),("[link](   /uri\n  \"title\"  )\n","<p><a href=\"/uri\" title=\"title\">link</a></p>\n"),("[link] (/uri)\n","<p>[link] (/uri)</p>\n"),("[link](foo(and(bar))\n","<p>[link](foo(and(bar))</p>\n"),("[link](foo(and(bar)))\n","<p><a href=\"foo(and(bar))\">link</a></p>\n"),
("[link](<>)\n","<p><a href=\"\">link</a></p>\n"),("[link]()\n","<p><a href=\"\">link</a></p>\n"),("[a](<b)c\n[a](<b)c>\n","<p>[a](&lt;b)c\n[a](&lt;b)c&gt;</p>\n"),("[foo <bar attr=\"](baz)\">\n","<p>[foo <bar attr=\"](baz)\"></p>\n"),("[foo`](/uri)`\n","<p>[foo<code>](/uri)</code></p>\n"),
("[foo *bar [baz](/uri)*](/uri)\n","<p>[foo <em>bar <a href=\"/uri\">baz</a></em>](/uri)</p>\n"),("[![moon](moon.jpg)](/uri)\n","<p><a href=\"/uri\"><img src=\"moon.jpg\" alt=\"moon\" /></a></p>\n"),
("[ẞ]\n\n[SS]: /url\n","<p><a href=\"/url\">ẞ</a></p>\n"),("[foo][ref[]\n\n[ref[]: /uri\n","<p>[foo][ref[]</p>\n<p>[ref[]: /uri</p>\n"),("[foo][ref\\[]\n\n[ref\\[]: /uri\n","<p><a href=\"/uri\">foo</a></p>\n"),("[]\n\n[]: /uri\n","<p>[]</p>\n<p>[]: /uri</p>\n"),("[foo][]\n\n[foo]: /url\n","<p><a href=\"/url\">foo</a></p>\n"),("[foo](not a link)\n\n[foo]: /url1\n","<p><a href=\"/url1\">foo</a>(not a link)</p>\n"),("[foo][bar][baz]\n\n[baz]: /url1\n[foo]: /url2\n","<p>[foo]<a href=\"/url1\">bar</a></p>\n"),
("!\\[foo]\n\n[foo]: /url\n","<p>![foo]</p>\n"),("\\![foo]\n\n[foo]: /url\n","<p>!<a href=\"/url\">foo</a></p>\n"),("<a+b+c:d>\n","<p><a href=\"a+b+c:d\">a+b+c:d</a></p>\n"),("<m:abc>\n","<p>&lt;m:abc&gt;</p>\n"),("< https://foo.bar >\n","<p>&lt; https://foo.bar &gt;</p>\n"),
("<a href=\"\\\"\">\n","<p>&lt;a href=&quot;&quot;&quot;&gt;</p>\n"),("<33> <__>\n","<p>&lt;33&gt; &lt;__&gt;</p>\n"),("foo  \nbaz\n","<p>foo<br />\nbaz</p>\n"),("### foo\\\n","<h3>foo\\</h3>\n"),("foo\\\n","<p>foo\\</p>\n"),("### foo  \n","<h3>foo</h3>\n"),
("a * foo bar*\n","<p>a * foo bar*</p>\n"),("*foo bar *\n","<p>*foo bar *</p>\n"),("_foo_bar_baz_\n","<p><em>foo_bar_baz</em></p>\n"),("foo-_(bar)_\n","<p>foo-<em>(bar)</em></p>\n"),("*foo [bar](/url)*\n","<p><em>foo <a href=\"/url\">bar</a></em></p>\n"),("**foo [bar](/url)**\n","<p><strong>foo <a href=\"/url\">bar</a></strong></p>\n"),("*foo **bar *baz* bim** bop*\n","<p><em>foo <strong>bar <em>baz</em> bim</strong> bop</em></p>\n"),("**foo*\n","<p>*<em>foo</em></p>\n"),("*foo**\n","<p><em>foo</em>*</p>\n"),("****foo*\n","<p>***<em>foo</em></p>\n"),("*foo __bar *baz bim__ bam*\n","<p><em>foo <strong>bar *baz bim</strong> bam</em></p>\n"),("**foo **bar baz**\n","<p>**foo <strong>bar baz</strong></p>\n"),("*[bar*](/url)\n","<p>*<a href=\"/url\">bar*</a></p>\n"),("*<img src=\"foo\" title=\"*\"/>\n","<p>*<img src=\"foo\" title=\"*\"/></p>\n"),("**a<https://foo.bar/?q=**>\n","<p>**a<a href=\"https://foo.bar/?q=**\">https://foo.bar/?q=**</a></p>\n"),("*a `*`*\n","<p><em>a <code>*</code></em></p>\n"),("***foo***\n","<p><em><strong>foo</strong></em></p>\n"),
("`<a href=\"`\">`\n","<p><code>&lt;a href=&quot;</code>&quot;&gt;`</p>\n"),("<a href=\"`\">`\n","<p><a href=\"`\">`</p>\n"),("```foo``\n","<p>```foo``</p>\n"),("`foo``bar``\n","<p>`foo<code>bar</code></p>\n"),("`` ` ``\n" ,"<p><code>`</code></p>\n"),("`  ``  `\n","<p><code> `` </code></p>\n"),("` a`\n","<p><code> a</code></p>\n"),
("&#X22; &#XD06; &#xcab;\n","<p>&quot; ആ ಫ</p>\n"),("&nbsp &x; &#; &#x; &#87654321; &#abcdef0; &ThisIsNotDefined; &hi?;\n","<p>&amp;nbsp &amp;x; &amp;#; &amp;#x; &amp;#87654321; &amp;#abcdef0; &amp;ThisIsNotDefined; &amp;hi?;</p>\n"),("[foo](/f&ouml;&ouml; \"f&ouml;&ouml;\")\n","<p><a href=\"/f%C3%B6%C3%B6\" title=\"föö\">foo</a></p>\n"),("``` f&ouml;&ouml;\nfoo\n```\n","<pre><code class=\"language-föö\">foo\n</code></pre>\n"),("&#42;foo&#42;\n*foo*\n","<p>*foo*\n<em>foo</em></p>\n"),("\\!\\\"\\#\\<\\&\n","<p>!&quot;#&lt;&amp;</p>\n"),("[foo](/bar\\* \"ti\\*tle\")\n","<p><a href=\"/bar*\" title=\"ti*tle\">foo</a></p>\n"),("``` foo\\+bar\nfoo\n```\n","<pre><code class=\"language-foo+bar\">foo\n</code></pre>\n"),
("Multiple     spaces\n","<p>Multiple     spaces</p>\n"),("- a\n  > b\n\n  c\n","<ul>\n<li>\n<p>a</p>\n<blockquote>\n<p>b</p>\n</blockquote>\n<p>c</p>\n</li>\n</ul>\n"),("- a\n\n  b\n","<ul>\n<li>\n<p>a</p>\n<p>b</p>\n</li>\n</ul>\n"),("1. ```\n   foo\n   ```\n\n   bar\n","<ol>\n<li>\n<pre><code>foo\n</code></pre>\n<p>bar</p>\n</li>\n</ol>\n"),
]


def dl(*parts):
    """A definition list: terms as strings, definitions in lists."""
    return "<dl>\n" + "".join(f"<dd>{p[0]}</dd>\n" if isinstance(p, list) else f"<dt>{p}</dt>\n" for p in parts) + "</dl>\n"


def note_section(*items):
    """The notes at the end: (id, body before the way back) for each."""
    rows = []
    for n, (name, body) in enumerate(items, 1):
        back = f'<a href="#user-content-{name.replace("fn-", "fnref-", 1)}" class="data-footnote-backref" aria-label="Back to reference {n}">↩</a>'
        rows.append(f'<li id="user-content-{name}">\n{body} {back}</p>\n</li>\n')
    return f'<section data-footnotes class="footnotes">\n<ol>\n{"".join(rows)}</ol>\n</section>\n'


def note_mark(name, n):
    return f'<sup><a href="#user-content-{name}" id="user-content-{name.replace("fn-", "fnref-", 1)}" data-footnote-ref>{n}</a></sup>'


#: The extensions' rules, one case a line: options, Markdown, HTML.
EXTENDED = [
    (TERMS, "salt\n: a mineral", dl("salt", ["a mineral"])),
    (TERMS, "salt\n\n: a mineral", dl("salt", ["\n<p>a mineral</p>\n"])),
    (TERMS, "salt\n: a mineral\nof the sea", dl("salt", ["a mineral\nof the sea"])),
    (TERMS, "salt\n: dry\n\nafter it\n\n## end", dl("salt", ["dry"]) + '<p>after it</p>\n<h2 id="end">end</h2>\n'),
    (TERMS, "> salt\n> : dry", "<blockquote>\n" + dl("salt", ["dry"]) + "</blockquote>\n"),
    (TERMS, "* salt\n  : dry", "<ul>\n<li>\n" + dl("salt", ["dry"]) + "</li>\n</ul>\n"),
    (TERMS, "* salt\n  : ### dry", "<ul>\n<li>\n" + dl("salt", ['<h3 id="dry">dry</h3>\n']) + "</li>\n</ul>\n"),
    (TERMS, "* salt\n  : dry\n\n* wet", "<ul>\n<li>\n" + dl("salt", ["dry"]) + "</li>\n<li>\n<p>wet</p>\n</li>\n</ul>\n"),
    (TERMS, "sea\n: wide\n\n    salt\n    : dry", dl("sea", ["wide\n" + dl("salt", ["dry"])])),
    (TERMS, "sea\n*salt* water\n: wide\n: deep", dl("sea", "<em>salt</em> water", ["wide"], ["deep"])),
    (TERMS, "salt\n     : dry", "<p>salt\n: dry</p>\n"),
    (DEFAULT, "salt\n: dry", "<p>salt\n: dry</p>\n"),
    (INLINE_NOTES, "Tea^[from leaves] first", f"<p>Tea{note_mark('inline-fn-1', 1)} first</p>\n" + note_section(("inline-fn-1", "<p>from leaves"))),
    (INLINE_NOTES, "tea ^[\t] 2^nd^", "<p>tea ^[\t] 2<sup>nd</sup></p>\n"),
    (NOTES, "tea[^q]!\n\n[^q]: green\n\n      black", f"<p>tea{note_mark('fn-q', 1)}!</p>\n" + note_section(("fn-q", "<p>green</p>\n<p>black"))),
    (DEFAULT, "> [!tip]\n> steep *long*", '<div class="markdown-alert markdown-alert-tip">\n<p class="markdown-alert-title">Tip</p>\n<p>steep <em>long</em></p>\n</div>\n'),
    (MERGED, "| x | y |\n|:-:|---|\n| both ||\n", '<table>\n<thead>\n<tr>\n<th align="center">x</th>\n<th>y</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td align="center" colspan="2">both</td>\n</tr>\n</tbody>\n</table>\n'),
    (COMMENTS, "tea\n// by hand\n===\n", '<h1 id="tea">tea</h1>\n'),
    (COMMENTS, "> tea\n// by hand\n> milk\n", "<blockquote>\n<p>tea\nmilk</p>\n</blockquote>\n"),
    (COMMENTS, " // by hand\n    // kept\n", "<pre><code>// kept\n</code></pre>\n"),
    (COMMENTS, "+ tea\n// by hand\n+ milk\n", "<ul>\n<li>tea</li>\n<li>milk</li>\n</ul>\n"),
    (DEFAULT, "1. [X] tea\n2. [ ] milk\n", '<ol>\n<li><input type="checkbox" checked="" disabled="" /> tea</li>\n<li><input type="checkbox" disabled="" /> milk</li>\n</ol>\n'),
    (DEFAULT, "| A | B |\n|---|:-:|\n| 1 | `a|b` |\n| x \\| y |\n", "<table>\n<thead>\n<tr>\n<th>A</th>\n<th align=\"center\">B</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td align=\"center\"><code>a|b</code></td>\n</tr>\n<tr>\n<td>x | y</td>\n<td align=\"center\"></td>\n</tr>\n</tbody>\n</table>\n"),
    (DEFAULT, "~~gone~~ ~not~", "<p><del>gone</del> ~not~</p>\n"),
    (of(highlight=True,subscript=True),"==hi== H~2~O", "<p><mark>hi</mark> H<sub>2</sub>O</p>\n"),
    (GFM, "www.commonmark.org/a_b. and https://x.org/(a)) me@x.org", "<p><a href=\"http://www.commonmark.org/a_b\">www.commonmark.org/a_b</a>. and <a href=\"https://x.org/(a)\">https://x.org/(a)</a>) <a href=\"mailto:me@x.org\">me@x.org</a></p>\n"),
    (DEFAULT, "[x](javascript:alert(1)) <b>hi</b>", "<p><a href=\"\">x</a> &lt;b&gt;hi&lt;/b&gt;</p>\n"),
    (DEFAULT, "# a\n# a\n# a-1\n# A & B", "<h1 id=\"a\">a</h1>\n<h1 id=\"a-1\">a</h1>\n<h1 id=\"a-1\">a-1</h1>\n<h1 id=\"a--b\">A &amp; B</h1>\n"),
    (of(math=True),"$x^2$ $$\n\\sum\n$$", "<p><code class=\"language-math math-inline\">x^2</code> <code class=\"language-math math-display\">\\sum</code></p>\n"),
    (of(link_base_path="/docs"),"[a](/b) [c](//d) [e](/docs/x)", "<p><a href=\"/docs/b\">a</a> <a href=\"//d\">c</a> <a href=\"/docs/x\">e</a></p>\n"),
    (of(table_column_widths=True),"a | b\n- | ---\n", "<table>\n<colgroup>\n<col style=\"width: 25%\">\n<col style=\"width: 75%\">\n</colgroup>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n</table>\n"),
]


@pytest.mark.parametrize(("source", "html"), COMMON + MORE)
def test_commonmark(source, html):
    assert to_html(source, TRUSTED) == html


@pytest.mark.parametrize(("opts", "source", "html"), EXTENDED)
def test_extensions(opts, source, html):
    assert to_html(source, opts) == html


def test_random_documents_compile_and_stay_safe():
    rng = random.Random(5)
    alphabet = "*_`~[]()<>!#-+=|:\\^$&\n\n\n  \t>ab1.x"
    every = of(definition_lists=True, footnotes=True, inline_footnotes=True, math=True, highlight=True, superscript=True, subscript=True, autolink_literals=True, merged_table_cells=True, front_matter=True)
    for k in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) + "<script>x</script>"
        html = to_html(s, every.with_(line_comments=bool(k % 2)))
        assert "<script" not in html
        found = events.block_events(s, every, True)
        assert [e["seq"] for e in found] == list(range(len(found)))
        opened = [e["kind"] for e in found if e["kind"].endswith("Start")]
        closed = [e["kind"] for e in found if e["kind"].endswith("End")]
        assert sorted(x[:-5] for x in opened) == sorted(x[:-3] for x in closed)


def test_presets():
    assert options("gfm") is GFM and options(None) is DEFAULT
    assert DEFAULT.heading_ids and DEFAULT.callouts and not DEFAULT.autolink_literals
    assert GFM.autolink_literals and not GFM.heading_ids
    assert not MINIMAL.allow_html and MINIMAL.indented_code_blocks
    assert MDX.trusted and MDX.front_matter and not MDX.disallowed_raw_html
    assert options({"renderPolicy": "trusted", "headingIds": False}).trusted
    with pytest.raises(ValueError):
        options({"render_policy": "odd"})
    with pytest.raises(ValueError):
        options({"nothing": True})


def test_document_api():
    r = compile_document("---\na: 1\n---\n# A *b* &amp; c\n\n## A", of(front_matter=True))
    assert r.front_matter == "a: 1\n"
    assert r.headings == [{"level": 1, "id": "a-b-amp-c", "text": "A b & c"}, {"level": 2, "id": "a", "text": "A"}]
    assert compile_document(None, DEFAULT).html == "" and compile_document("", DEFAULT).html == ""


def test_renderer_of_fenced_code():
    def own(language, meta, code):
        if language == "boom":
            raise RuntimeError
        return None if language is None else f"<x>{language}|{meta}|{code}</x>"

    assert to_html("```a b c\n1\n```", DEFAULT, own) == "<x>a|b c|1\n</x>"
    assert to_html("```boom\n1\n```", DEFAULT, own) == '<pre><code class="language-boom">1\n</code></pre>\n'
    assert to_html("    1\n", DEFAULT, own) == "<pre><code>1\n</code></pre>\n"


def test_urls():
    assert T.is_safe_url("https://x") and T.is_safe_url("/a:b") and T.is_safe_url("é:x") and T.is_safe_url("1a:x")
    assert not T.is_safe_url("JAVA&#115;cript:x") and not T.is_safe_url(" java\nscript:x") and not T.is_safe_url("a" * 17 + ":x")
    assert T.encode_destination('a b"\\é&amp;\'') == "a%20b%22%5C%C3%A9&amp;&#39;"
    assert T.with_base("/a", "/b/") == "/b/a" and T.with_base("/b/a", "/b") == "/b/a" and T.with_base("/bc", "/b") == "/b/bc"


def test_widths_add_up():
    rng = random.Random(1)
    for _ in range(300):
        assert sum(T.column_widths([rng.randint(1, 40) for _ in range(rng.randint(1, 20))])) == 10000


def test_limits():
    assert to_html("> " * 40 + "x", DEFAULT).count("<blockquote>") == 32
    assert to_html("`" * 33 + "a" + "`" * 33, DEFAULT).count("<code>") == 0
    assert "<ol" not in to_html("1234567890. x", DEFAULT)


def test_mdx():
    s = "import A from 'a'\n\n# Hi\n\n<Card a=\"1\" b={`x${1}`} {...p}>\n\nText\n\n</Card>\n<Br />\n{/* c */}\nend\n"
    assert [x.kind for x in mdx.segments(s)] == ["Esm", "Markdown", "JsxBlockOpen", "Markdown", "JsxBlockClose", "JsxBlockSelfClose", "Expression", "Markdown"]
    assert mdx.diagnostics(s) == []
    out = mdx.render_mdx(s).to_component("Page")
    assert out.startswith("import A from 'a'\n\nexport function Page() {\n  return (\n    <>\n      <h1 id=\"hi\">Hi</h1>\n")
    for bad in ("", "1a", "a-b", "class"):
        with pytest.raises(ValueError):
            mdx.check_name(bad)


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("{a", [("UnterminatedExpression", 0, 2)]),
        ("<Card", [("UnterminatedJsxTag", 0, 5)]),
        ("</A>", [("UnexpectedJsxClosingTag", 0, 4)]),
        ("<A>\n<B>\n</A>\n", [("MismatchedJsxClosingTag", 8, 12)]),
        (" import x from 'y'\n", [("InvalidEsmPosition", 1, 7)]),
        ("<A b=>\n", [("InvalidJsxTag", 0, 6)]),
        ("<A>", [("UnclosedJsxTag", 0, 3)]),
    ],
)
def test_mdx_diagnostics(source, found):
    assert [(d.code, d.start, d.end) for d in mdx.diagnostics(source)] == found


def test_mdx_segments_cover_the_text():
    rng = random.Random(3)
    bits = ["<", "A", ">", "/", "{", "}", "\n", " ", "=", '"', "'", "`", "import ", "export ", "x", "$", ";", "\n\n", "</A>", "<A>"]
    for _ in range(3000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert "".join(x.text for x in mdx.segments(s)) == s
        mdx.diagnostics(s)
        mdx.render_mdx(s)


def test_mdx_events():
    found = events.mdx_events("---\na: é\n---\n# é [x]\n\n<A>\n\n[x]: /u\n")
    assert found[0]["kind"] == "FrontMatter" and found[0]["end"] == 14
    link = next(e for e in found if e["kind"] == "LinkStartRef")  # a reference names its definition
    assert link["url"] == "/u" and link["start"] == 19 and link["def_index"] == 0
    with pytest.raises(ValueError):
        events.mdx_events("<A>", strict=True)


def test_mdx_stream_has_definitions_and_places():
    s = "[b]: /b\n\n<A />\n\né ![i][a] [b] [w](</w> 't')\n\n[a]: /a\n"
    found = events.mdx_stream(s)
    assert found.version == 2
    refs = [(e["kind"], found.link_reference(e["def_index"])["url"]) for e in found.events if e.get("def_index") is not None]
    assert refs == [("ImageStartRef", "/a"), ("LinkStartRef", "/b")]
    assert found.link_reference(2) is None
    direct = next(e for e in found.events if e["kind"] == "LinkStart")
    a, b = events.source_range(direct)
    assert s.encode()[a:b] == b"/w" and direct["title"] == "t"
    assert [events.source_range(e) is None for e in found.events if e["kind"] in ("ParagraphStart", "LinkEnd", "LinkStartRef")] == [True] * 4
    jsx = next(e for e in found.events if e["kind"] == "FlowJsxSelfClose")
    assert s.encode()[slice(*events.source_range(jsx))].strip() == b"<A />"


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("    a\n", [("Code", None, "a\n")]),
        ("      a\n\n    b", [("VirtualSpaces", 2, None), ("Code", None, "a\n"), ("Code", None, "\n"), ("Code", None, "b")]),
        ("\t\ta", [("VirtualSpaces", 4, None), ("Code", None, "a")]),
        ("> \t\tx\n", [("VirtualSpaces", 2, None), ("Code", None, "x\n")]),
        ("```\n  a\n```\n", [("Code", None, "  a\n")]),
    ],
)
def test_code_events(source, found):
    """Columns beyond the fourth are virtual spaces; places and texts of lines include their line feeds."""
    code = [e for e in events.block_events(source) if e["kind"] in ("VirtualSpaces", "Code")]
    assert [(e["kind"], e.get("spaces"), e.get("text")) for e in code] == found
    assert all(source.encode()[e["start"] : e["end"]].decode() == e["text"] for e in code if e["kind"] == "Code")


def test_mdx_inline_events():
    kinds = lambda s: [(e["kind"], e.get("text")) for e in events.mdx_events(s) if e["kind"].startswith(("Mdx", "Flow"))]
    assert kinds("Hello {user.name}!") == [("MdxExpression", "{user.name}")]
    assert kinds('Read <Badge>it</Badge> and <Icon name="b" />.') == [("MdxJsxOpen", "<Badge>"), ("MdxJsxClose", "</Badge>"), ("MdxJsxSelfClose", '<Icon name="b" />')]
    assert kinds("> <Card />\n>\n> {x}\n>\n> a {y}") == [("FlowJsxSelfClose", "<Card />"), ("FlowExpression", "{x}"), ("MdxExpression", "{y}")]
    assert kinds("Broken {user and <Badge prop=") == []
    assert kinds("`{literal}` \\{escaped\\}") == []


@pytest.mark.parametrize(
    ("source", "html"),
    [
        ("<p>x", "<p>x"),
        ("<p>x\n", "<p>x\n"),
        ("<!-- a\nb -->", "<!-- a\nb -->"),
        ("> <p>x", "<blockquote>\n<p>x</blockquote>\n"),
        ("    x", "<pre><code>x</code></pre>\n"),
        ("    x\n\n", "<pre><code>x\n</code></pre>\n"),
        ("```\nx", "<pre><code>x</code></pre>\n"),
        ("```\nx\n```", "<pre><code>x\n</code></pre>\n"),
        ("```", "<pre><code></code></pre>\n"),
        ("- a\n\n      x", "<ul>\n<li>\n<p>a</p>\n<pre><code>x</code></pre>\n</li>\n</ul>\n"),
        ("x", "<p>x</p>\n"),
        ("# x", '<h1 id="x">x</h1>\n'),
        ("> x", "<blockquote>\n<p>x</p>\n</blockquote>\n"),
    ],
)
def test_documents_without_a_last_line_feed(source, html):
    assert to_html(source, DEFAULT.with_(render_policy="trusted")) == html


@pytest.mark.parametrize("part", ["<![CDATA[", "<!--", "<?x", "<!x", "<a ", "[", "*a", "`", "![a](", "&am"])
def test_openings_without_an_end_take_linear_time(part):
    import time

    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        to_html("a " + part * (n // len(part)), DEFAULT.with_(render_policy="trusted"))
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.3


@pytest.mark.parametrize(
    ("run", "part"),
    [
        (lambda t: to_html(t, DEFAULT.with_(footnotes=True, inline_footnotes=True)), "a^["), (lambda t: to_html(t, DEFAULT.with_(footnotes=True, inline_footnotes=True)), "^[`a"),
        (mdx.segments, "{a\n\n"), (mdx.segments, "a {b}\n{c\n"), (mdx.render_mdx, "{a\n\n"), (lambda t: to_html(t + "@", DEFAULT.with_(autolink_literals=True)), "abc."), (lambda t: to_html(t + "@", DEFAULT.with_(autolink_literals=True)), "a"),
        (lambda t: to_html("<script>\n\n" + t, DEFAULT), "A\n\n"), (lambda t: to_html(t, DEFAULT), "# A\n\n```\n\nB\n```\n"),
    ],
)
def test_more_openings_take_linear_time(run, part):
    import time

    took = []
    for n in (10_000, 40_000):
        start = time.process_time()
        run(part * (n // len(part)))
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.3
