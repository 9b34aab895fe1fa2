"""Language identification (6) and WARC derivatives (7)."""

import hashlib
import html
import math
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidepanel.llm import language_id as li, warc
from tidepanel.llm.common import table


def test_text_and_hosts_outvote_a_wrong_declaration(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("n_chars > 300").select("doc_id", "text", "lang", F.concat(F.lit("h-"), "lang").alias("host"))
    wrong = F.when(F.col("doc_id") % 13 == 0, F.lit("es")).otherwise(F.col("lang"))
    got = li.identify(docs.withColumn("said", wrong).withColumn("true", F.col("lang")), declared="said", host=F.col("host"), keep=("doc_id", "true")).collect()
    assert len(got) == docs.count()
    assert sum(r.language == r.true for r in got) / len(got) > 0.99


def test_host_prior_decides_without_text(spark):
    rows = [(i, "das ist ein deutscher text und noch ein satz " * 3, "de", "a.de") for i in range(30)]
    rows += [(100 + i, "the quick brown fox and the lazy dog run " * 3, "en", "b.com") for i in range(30)]
    rows += [(900, None, None, "a.de"), (901, "", None, "b.com"), (902, None, None, None), (903, "", "xx-YY", None), (904, "x" * 50000, "EN-us", "c.fr"), (None, "a", "de", "a.de"), (900, None, None, "a.de")]
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string").withColumn("declared_extra", F.lit(1)).withColumn("language", F.lit("zz"))
    got = li.identify(df, suffix=li.suffix_of(F.col("host")), host=F.col("host"), keep=("id",)).collect()
    by = {r.id: r for r in got}
    assert len(got) == len(rows) and by[900].language == "de" and by[901].language == "en" and by[900].confidence > 0.8
    assert all(math.isclose(sum(r.posterior), 1) for r in got) and by[904].declared == "en"
    assert by[902].text_language is None
    assert li.identify(df.limit(0), keep=("id",)).collect() == []


def test_posterior_against_plain_sums(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["un ", "der ", "the ", "el "]) for _ in range(4)), rng.choice(["en", "de", None, "fr"]), rng.choice(["h1", "h2", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string")
    got = {r.id: r for r in li.identify(df, host=F.col("host"), keep=("id",)).collect()}
    langs, n = li.LANGUAGES, 4
    counts = [[li.ALPHA] * li.BUCKETS for _ in langs]
    for _, t, d, _ in rows:
        if d in langs:
            for x in li.trigrams(t.encode()):
                counts[langs.index(d)][x] += 1
    total = [sum(c) for c in counts]
    ll = {i: [sum(math.log(counts[k][x] / total[k]) for x in li.trigrams(t.encode())) / li.DAMP for k in range(n)] for i, t, _, _ in rows}
    vote = {i: max(range(n), key=v.__getitem__) for i, v in ll.items()}
    prior = [1 + sum(v == k for v in vote.values()) for k in range(n)]
    prior = [p / sum(prior) for p in prior]
    for i, _, d, h in rows:
        score = []
        for k in range(n):
            own = vote[i] == k
            said = 0.0 if d is None else math.log((sum(vote[j] == k for j, _, e, _ in rows if e == d) + 1) / (sum(vote[j] == k for j, _, e, _ in rows if e) + n + 1))
            here = [sum(vote[j] == m for j, _, _, g in rows if h and g == h) - (vote[i] == m) * bool(h) for m in range(n)]
            at_suffix = li.KAPPA * prior[k] / li.KAPPA
            score.append(ll[i][k] + said + math.log((max(here[k], 0) + li.KAPPA * at_suffix) / (sum(max(x, 0) for x in here) + li.KAPPA)))
            assert own in (True, False)
        e = [math.exp(s - max(score)) for s in score]
        assert got[i].posterior == pytest.approx([x / sum(e) for x in e], abs=1e-6)


def parse(blob: bytes):
    """WARC records of a file: (headers, block)."""
    out = []
    while blob:
        head, blob = blob.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        h = dict(x.split(": ", 1) for x in lines[1:])
        n = int(h["Content-Length"])
        out.append((h, blob[:n]))
        assert blob[n:n + 4] == b"\r\n\r\n"
        blob = blob[n + 4:]
    return out


def test_files_parse_back(spark, tmp_path):
    pages = table(spark, SF, "pages")
    found = warc.responses(pages)
    source = {r.record_id: r for r in found.collect()}
    warc.write(warc.derive(found).coalesce(1), str(tmp_path / "w"))
    records = parse(next((tmp_path / "w").glob("part-*")).read_bytes())
    assert len(records) == 2 * len(source)
    ids = {h["WARC-Record-ID"] for h, _ in records}
    assert len(ids) == len(records)
    for h, block in records:
        r = source[h["WARC-Refers-To"]]
        assert h["WARC-Target-URI"] == r.target_uri and h["WARC-Date"] == r.date
        assert h["X-Source-Payload-Digest"] == r.payload_digest == "sha256:" + hashlib.sha256(r.payload.encode()).hexdigest()
        assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        if h["WARC-Type"] == "conversion":
            assert h["WARC-Concurrent-To"] in ids and b"<p>" not in block and b"track(" not in block


def test_warc_edges(spark):
    rows = [(1, "http://a.b/", "<html lang='fr'><title> A\n b </title><p>x &amp;lt; y<br>z<!-- c --><script>bad()</script>"), (2, None, None), (None, "u", ""), (1, "u", "plain " * 30000), (3, "u", "< <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("date", F.lit("x"))
    got = warc.derive(warc.responses(df)).collect()
    assert len(got) == 2 * len(rows)
    first = {r.record_type: r for r in got if r.target_uri == "http://a.b/"}
    assert first["conversion"].block == "x &lt; y\nz" and first["metadata"].block.startswith("source-content-type: text/html; charset=utf-8\r\ntitle: A b\r\nlanguage: fr\r\noutlinks: 0")
    assert all(r.content_length == len(r.block.encode()) for r in got)
    lost = warc.responses(df).withColumn("record_id", F.lit(None).cast("string"))
    assert all(r.refers_to is None and r.record_id for r in warc.derive(lost).collect())
    assert warc.derive(warc.responses(df.limit(0))).collect() == []


def test_references_against_the_standard_library(spark):
    rng = random.Random(5)
    bits = ["&eacute;", "&mdash;", "&#8217;", "&#xE9;", "&#x1F600;", "&amp;lt;", "&lt;", "&unknown;", "&", "&&", "a;b", " & ", "&#;", "&#x;", "&#xD800;", "&#0;", "&#9999999;", "&frac12;", "x", "é", "&AMP", "&hellip;"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))).replace("&AMP", "& AMP") for _ in range(300)] + ["", "&", None, "&amp;" * 20000]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(warc.unescaped(F.col("t")).alias("t")).collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]


class _Links(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.found = []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.found += [v for k, v in attrs if tag == "a" and k == "href"]


def test_links_of_any_quoting_against_a_parser(spark):
    rng = random.Random(6)
    tags = ['<a href="/p?x=1">', "<a href='/q \"z\"'>", "<a class=k href=/r>", '<A\nTITLE="t" HREF = "/s">', '<a data-href="/no" href="/t">', '<link href="/no">', '<a name="n">', "<abbr href=/no>", '<a href="">']
    pages = ["<body>" + "".join(rng.choices(tags, k=8)) + "</a>" for _ in range(60)]
    df = spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.block for r in warc.derive(warc.responses(df)).collect() if r.record_type == "metadata"}
    for i, page in enumerate(pages):
        lines = [x for x in got[i].split("\r\n") if x.startswith("outlink")]
        want = _Links(page).found
        assert lines == [f"outlinks: {len(want)}"] + [f"outlink: {x}" for x in want]


def test_other_payloads_of_an_address_have_other_ids(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (1, "u", "a"), (1, None, "a"), (None, "u", "a")], "page_id long, url string, html string")
    found = warc.responses(df)
    assert len({r.record_id for r in found.collect()}) == 4 and len({r.record_id for r in warc.responses(df, "2025-01-01T00:00:00Z").union(found).collect()}) == 8
    out = warc.derive(found).collect()
    assert len({r.record_id for r in out}) == 8 and all(len({r.block for r in out if r.record_id == i}) == 1 for i in {r.record_id for r in out})


def test_http_heads_reach_the_metadata(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=gbk\r\nSet-Cookie: a=1: b\r\nset-cookie:c\r\nno colon\r\n\r\n"
    rows = [("r1", head + "<p>x\r\n\r\ny"), ("r2", "HTTP/1.0 404 Not Found\nX: 1"), ("r3", "no head: <p>z"), ("r4", None), ("r5", "")]
    df = spark.createDataFrame(rows, "record_id string, block string").select("record_id", F.lit(1).alias("page_id"), F.lit("u").alias("target_uri"), F.lit("d").alias("date"), "block")
    found = warc.parse_http(df)
    got = {r.record_id: r for r in found.collect()}
    assert [got[f"r{i}"].http_status for i in range(1, 6)] == [200, 404, None, None, None]
    assert got["r1"].payload == "<p>x\r\n\r\ny" and got["r2"].payload == "" and got["r3"].payload == "no head: <p>z" and got["r4"].payload == ""
    assert got["r1"].payload_digest == "sha256:" + hashlib.sha256(got["r1"].payload.encode()).hexdigest()
    meta = {r.refers_to: r.block for r in warc.derive(found).collect() if r.record_type == "metadata"}
    assert meta["r1"] == "source-content-type: text/html; charset=gbk\r\nsource-set-cookie: a=1: b\r\nsource-set-cookie: c\r\noutlinks: 0\r\n"
    assert meta["r2"].startswith("source-x: 1\r\n") and meta["r3"] == "outlinks: 0\r\n"
