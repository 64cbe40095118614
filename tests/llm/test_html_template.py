import pytest

from candlemill.llm.html_template import content_paths, deduce_templates, extract, main_text

SCHEMA = "page_id long, url string, html string, host string, content string, text string"


def run(spark, pages):
    table = spark.createDataFrame([(i, u, h, "h", "c", "t") for i, u, h in pages], SCHEMA)
    return {r.page_id: (r.text, r.n_chars) for r in extract(table).collect()}


def page(i, body, foot="terms and conditions"):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><script>var x = '</p>' + {i};</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>{body}<footer>{foot}</footer></body></html>"


@pytest.mark.parametrize(("html", "text"), [
    ("<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four</article>", "A & B\n\none two three\n\nfour"),
    ("<article><p>a<script>if (a < b) x();</script> b</p><aside>no</aside><form>no<p>no</form><div class='comments'>no<p>no</p></div><p>c</article>", "a b\n\nc"),
    ("<body><div id=cookie-notice>no</div><main><p>yes <b>it</b>em</p></main><div class='sidebar'>no</div>", "yes item"),
    ("<article><!-- <p>no</p> --><p>x &lt;p&gt; &#233;&nbsp;y</p>", "x <p> é y"),
    ("<article><p title=\"a>b\">kept</p><p>cut of", "kept\n\ncut of"),
    ("<article><p>a</p><style>no", "a"), ("plain text", "plain text"), ("", ""), (None, ""), ("<p", ""), ("<article></article>", ""),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
])
def test_one_page(html, text):
    assert main_text(html, None, set()) == text


def test_template_of_a_host_without_article(spark):
    pages = [(i, f"http://a.net/{i}", page(i, f"<div class=top>Welcome to our site</div><div class=story><h2>Head {i}</h2><p>" + f"story {i} " * 20 + "</p><p>more " + str(i) + "</p><div class=x>Read on</div></div>")) for i in range(6)]
    found = run(spark, pages)
    for i in range(6):
        assert found[i][0] == f"Head {i}\n\n" + (f"story {i} " * 20).strip() + f"\n\nmore {i}" and found[i][1] == len(found[i][0])


def test_classes_and_content(spark):
    pages = spark.createDataFrame([("h", page(i, f"<article><h1>t{i}</h1>" + f"<p>p{i}</p>" * (i + 1) + "</article>")) for i in range(4)], "host string, html string")
    tokens = {r.path: r for r in deduce_templates(pages).collect()}
    assert tokens["html/body/article"]["class"] == tokens["html/body/article/h1"]["class"] == tokens["html"]["class"]
    assert tokens["html/body/article/p"]["class"] != tokens["html"]["class"] and tokens["html/body/article/p"].n == 10
    assert tokens["html/body/footer"].skip and not tokens["html/body/footer"].varies
    assert content_paths(deduce_templates(pages)).first().content == "html/body/article"


def test_edges(spark):
    same = page(1, "<article><h1>Same</h1><p>the same text</p></article>")
    pages = [(i, "http://copies.net/", same) for i in range(5)] + [(0, "http://copies.net/", same)]
    pages += [(10, None, "<p>no url</p>"), (11, "http://one.net/", None), (12, "http://one.net/", ""), (None, "http://x.net", same), (13, "http://copies.net/other", "<html><body><main>other layout</main>")]
    pages += [(14, "http://long.net/", "<article>" + "<p>word &eacute;</p>" * 20_000)]
    found = run(spark, pages)
    assert found[0] == ("Same\n\nthe same text", 19) and found[10][0] == "no url" and found[11] == found[12] == ("", 0)
    assert found[13][0] == "other layout" and found[14][1] == 20_000 * 8 - 2 and found[None][0].startswith("Same")
    assert run(spark, []) == {}
