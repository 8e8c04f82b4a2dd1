"""Flat documents compiled by windows over their lines against the compiler."""

import random

from markloom.kernel.options import DEFAULT
from markloom.kernel.render import to_html
from markloom.plans import flat

LINES = ["Some text, (and) more; a-b + c 1. x", "Ünï \"q\" 'z'", "", "", "  ", "# Head", "## Head", "###### Ünï-x \"q\"", "***", "___", "---", "- item one", "- Ünï 'q'", "```", "```", "```py", "B 50% 3/4"]
INSIDE = ["x < y & z", "    deep", "- no item", "# no head", "[a]: /b", "\ttab", "| a |", "~~~", "*a*"]
HARD = ["*a*", "- ", "-  two", "text  ", "a: b", "> q", "1. one", "    code", "```py x", "  ```", "~~~", "#no", "# Head #", "+ x", "a\\", "![", "x@y.z", "=== ", "http://a", " lead", "<b>"]


def documents(rng, n):
    out = ["", "\n", "one", "one\n", "\n\none\n\n\n", "- a\n\n- b", "- a\n\n```\nx\n```\n\n- b", "- a\ntext", "text\n---", "text\n\n---\n", "---", "```\nopen", "- a\n***\n- b", "text\n- a\n# h\n- b\n"]
    for _ in range(n):
        body, fenced = [], False
        for _ in range(rng.randint(1, 14)):
            line = rng.choice(INSIDE if fenced and rng.random() < 0.7 else HARD if rng.random() < 0.03 else LINES)
            fenced = fenced != line.startswith("```")
            body.append(line)
        out.append("\n".join(body + (["```"] if fenced and rng.random() < 0.9 else [])) + rng.choice(["", "\n"]))
    return out


def test_flat_documents_are_what_the_compiler_makes(spark):
    texts = documents(random.Random(3), 1500)
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    for opts in (DEFAULT, DEFAULT.with_(heading_ids=False)):
        found = {r["doc_id"]: (r["html"], r["native"]) for r in flat.rendered(docs, opts).collect()}
        assert found.pop(-1) == (None, False) and len(found) == len(texts)
        for k, t in enumerate(texts):
            assert found[k][0] == to_html(t, opts), repr(t)
        assert 0.3 < sum(native for _, native in found.values()) / len(texts) < 0.95
    assert "Python" not in flat.compiled(docs)._jdf.queryExecution().executedPlan().toString()


def test_what_is_not_flat(spark):
    docs = spark.createDataFrame([(k, f"Fine\n\n{t}\n\nfine") for k, t in enumerate(HARD)], "doc_id long, text string")
    assert flat.compiled(docs).count() == 0
