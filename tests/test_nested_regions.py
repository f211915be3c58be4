"""Nested regions against the parser of the standard library."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from newspulse.functions import html as H

VOID = frozenset(H.VOID_TAGS)


class Reader(HTMLParser):
    """Text of the first element with a tag and class."""

    def __init__(self, tag, cls):
        super().__init__(convert_charrefs=True)
        self.tag, self.cls, self.found, self.depth, self.stack = tag, cls, None, None, []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.stack.append(tag)
        cls = dict(attrs).get("class") or ""
        if tag == self.tag and (self.cls is None or self.cls in cls.split()) and self.found is None:
            self.found, self.depth = [], len(self.stack)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack.pop() != tag:
            pass
        if self.depth is not None and len(self.stack) < self.depth:
            self.depth = None

    def handle_data(self, data):
        if self.depth is not None and not (self.stack and self.stack[-1] in ("script", "style")):
            self.found.append(data)


def parsed(html, tag, cls):
    reader = Reader(tag, cls)
    reader.feed(html or "")
    reader.close()
    return None if reader.found is None else "".join(reader.found)


def same(spark, pages, tag, cls):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: r.text for r in df.select("id", H.nested_text(F.col("html"), tag, cls).alias("text")).collect()}
    assert got == {i: parsed(p, tag, cls) for i, p in enumerate(pages)}


def test_nested_regions_of_awkward_pages(spark):
    same(spark, [
        "<div class='body'>a<div>b<div>c</div></div>d</div>e", "<DIV CLASS=body>a<div/>b</DIV>c", "<div class=body>never closed <p>x",
        "<section><div class=body>a<p>b</section>c</div>", "<div class='x body y'>a</p></span>b</div>c", "none", "", None,
        "<div class=body>a<br>b<img src=x>c<!-- </div> -->d<script>if (a</div>) 1</script>e<style></div></style>f</div>g",
        "<!-- <div class=body>no</div> --><div class=body>yes &amp; &eacute; &lt;b&gt;</div>", "<div class=body></div>tail",
        "<div>a<div class=body>b<div class=body>c</div>d</div>e</div><div class=body>f</div>", "<div class=nobody>a</div>",
        "<div class=body>" + "<div>x" * 300 + "</div>" * 300 + "end</div>out", "<div class=body>" + "w " * 50000 + "</div>z",
    ], "div", "body")


def test_nested_regions_of_random_pages(spark):
    draw = random.Random(6)
    parts = ["<div>", "<div class=\"body\">", "</div>", "<p>", "</p>", "<b>", "</b>", "t", " u ", "<br>", "</i>", "<div class='a body'>", "<li>", "</ul>", "<ul>"]
    pages = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 40))) for _ in range(300)]
    same(spark, pages, "div", "body")
    same(spark, pages, "ul", None)
