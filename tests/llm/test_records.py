"""URL filter, main text, WARC and preference formatting."""

import hashlib
import io
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from feedlens.llm import preferences, registry, urls, warc
from feedlens.llm.html_text import best_region, extract_main_text, fit_weights, main_text


# ---- urls ----


def slow_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for rule in registry.URL_RULES:
        h, _, p = rule.pattern.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.pattern) > len(best.pattern)):
            best = rule
    return host, path, best and best.pattern, best.verdict if best else "allow"


def test_urls_equal_plain_matching(spark):
    rng = random.Random(4)
    hosts = ["example.org", "WWW.Example.ORG", "xexample.org", "com", "a.b.com", "org", "organic.net", "evil.net", "de.com:80", "é.org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/", "/de/y", "/org/", "/x.org/es/", "?q=/fr/", "#/de/", "/" + "z" * 5000]
    listed = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=b', '#t'])}" for _ in range(400)]
    listed += [None, "", "no scheme", "mailto:a@b.org", "://org/", "http://a://org/", "http://org/\n/x"]
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(listed)] + [(None, "http://x.org/", "h", "p", "r")], "page_id long, url string, host string, path string, rule string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, registry.URL_RULES).collect()}
    assert out == {i: slow_verdict(u) for i, u in enumerate(listed)} | {None: ("x.org", "/", "org/", "allow")}


def test_many_rules_fill_several_words_and_globs_stop_at_slashes(spark):
    rules = [urls.Rule("block", f"host{i}.test/path{i}/") for i in range(60)] + [urls.Rule("allow", "a*.test/x*y"), urls.Rule("block", "end.test")]
    assert urls.ShiftAnd([r.glob for r in rules]).words > 10
    cases = {"http://m.host37.test/path37/": "host37.test/path37/", "http://abc.test/x12y/": "a*.test/x*y", "http://abc.test/x1/2y": None, "http://end.test": "end.test", "http://end.testing/": None}
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    assert [r["rule"] for r in urls.judge_urls(df, rules).orderBy("page_id").collect()] == list(cases.values())


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge_urls(df, []).first()["verdict"] == "allow"
    assert urls.judge_urls(df.limit(0), registry.URL_RULES).collect() == []


# ---- main text ----

ARTICLE = "<h1>A title</h1><p>First words here &amp; there,\n  more <b>bold</b>text.<p>Second one with <a href='x>y'>a link</a>.<ul><li>one item<li>two items</ul><p>Last<br>line of it.</p>"
TEXT = "A title\nFirst words here & there, more boldtext.\nSecond one with a link.\none item\ntwo items\nLast line of it."
AROUND = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header>"
    "<nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav><div class='cookie-notice'><p>We use cookies for this and that.</p></div>{}"
    "<!-- <p>gone</p> --><section id=comments><h3>Comments</h3><p>I liked it, a nice long text with words.</p></section>"
    "<aside><p>Also read this and that</p></aside><form><p>Your mail</p><input></form><footer><p>&copy; Someone, all of it</p></footer></body></html>"
)


def page(inner):
    return AROUND.format(inner)


@pytest.fixture(scope="module")
def weights(spark):
    pages = [page(f"<article>{ARTICLE}</article>")] * 3 + [page(f"<div class=ad>Buy it</div><article>{ARTICLE * 2}</article>")]
    return fit_weights(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string"))


@pytest.mark.parametrize("inner", [
    f"<article>{ARTICLE}</article>",
    f"<main><article class='post'>{ARTICLE}</article></main>",
    f"<main>{ARTICLE}</main>",
    f"<div id=content>{ARTICLE}</div>",
    f"<ARTICLE>{ARTICLE.replace('<p>Second', '<div class=\"ad-slot\"><p>Buy now, only today.</p></div><p>Second')}</ARTICLE>",
    f"<article>{ARTICLE}<div class='share'><a>Tell</a></div></article><aside><article><p>teaser</p></article></aside>",
])
def test_main_text_of_pages(weights, inner):
    assert main_text(page(inner), weights) == TEXT


SOCIAL = "<h2 id='related-work'>Related work</h2><section id='search'><h3 id=search>Search</h3><p class='social-impact'>How we searched.</p></section>"


@pytest.mark.parametrize("inner, more", [
    (f"<div class='layout has-sidebar'><article>{ARTICLE}</article></div>", ""),
    (f"<div class='page-with-comments'><article>{ARTICLE}</article></div>", ""),
    (f"<div class='sidebar'><article>{ARTICLE * 3}</article></div>", ("\n" + TEXT) * 2),
    (f"<div id='search'><article>{ARTICLE}</article></div>", ""),
    (f"<article>{ARTICLE}{SOCIAL}</article>", "\nRelated work\nSearch\nHow we searched."),
    (f"<main>{ARTICLE}{SOCIAL}</main>", "\nRelated work\nSearch\nHow we searched."),
    (f"<main>{ARTICLE * 4}</main><article class='comment'>{'<p>I think so too.</p>' * 3}</article>", ("\n" + TEXT) * 3),
    (f"<main>{ARTICLE * 4}<article class='comment'>{'<p>I think so too.</p>' * 3}</article></main>", ("\n" + TEXT) * 3),
    (f"<main>{ARTICLE * 4}</main><article><p>Another short one</p></article>", ("\n" + TEXT) * 3),
    (f"<article>{ARTICLE * 4}<article class='comment'><p>I think so too.</p></article></article>", ("\n" + TEXT) * 3),
])
def test_hints_take_no_text_from_the_article(weights, inner, more):
    assert main_text(page(inner), weights) == TEXT + more


def test_odd_pages(spark, weights):
    long = "<article>" + "<p>word &lt; word</p>" * 20_000 + "</article>"
    cases = ["", None, "just words", "<p", "<<<>>>", "<script>x", "<!-- open", "a < b and c > d", "&nbsp;&#32;", long, "<div>" * 3000 + "deep words" + "</div>" * 10]
    want = ["", "", "just words", None, None, "", "", "a < b and c > d", "", "\n".join(["word < word"] * 20_000), "deep words"]
    df = spark.createDataFrame([(i, h, "t", 5) for i, h in enumerate(cases)] + [(None, "x y", "t", 5)], "page_id long, html string, text string, n_chars int")
    out = {r["page_id"]: r for r in extract_main_text(df, weights).collect()}
    assert len(out) == len(cases) + 1 and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert [out[i]["text"] for i, w in enumerate(want) if w is not None] == [w for w in want if w is not None]
    assert extract_main_text(df.limit(0), weights).collect() == []


def test_best_region_equals_all_regions():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(-3, 4) for _ in range(rng.randrange(0, 12))]
        b, e = best_region(s)
        assert sum(s[b:e]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_unlabelled_pages_still_give_text(spark):
    none = fit_weights(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string"))
    assert none == {} and main_text(page(f"<div>{ARTICLE}</div>"), none) == TEXT


# ---- warc ----


def rows_of_pages():
    big, small = "same page " * 30, "short"
    texts = [big, big, small, small, None, "", "é" * 60, "é" * 60, "x" * 300_000, big + "\r\n\r\nWARC/1.1\r\n"]
    return [(i + 1, f"http://h/{i}\r\nX: y" if i else None, t, "d", 1) for i, t in enumerate(texts)]


def test_archive_round_trip(spark):
    rows = rows_of_pages()
    df = spark.createDataFrame([*rows, rows[0], (None, "http://n/", "same page " * 30, "d", 1)], "page_id long, url string, html string, digest string, length int").repartition(3)
    out = [tuple(r)[:5] for r in warc.archive_round_trip(df).collect()]
    payload = [(r[0], (r[2] or "").encode()) for r in [*rows, rows[0], (None, None, "same page " * 30)]]
    want = []
    for i, p in payload:
        first = min((j for j, q in payload if q == p and j is not None), default=None)
        revisit = len(p) >= 100 and i != first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_small_files_hold_all_payloads(spark, tmp_path):
    df = spark.createDataFrame(rows_of_pages(), "page_id long, url string, html string, digest string, length int").repartition(2)
    manifest = warc.write_warc(df, f"file://{tmp_path}/w", file_bytes=200)
    out = warc.read_warc(manifest, with_payload=True).collect()
    assert manifest.count() > 2 and sum(r["records"] for r in manifest.collect()) == len(out) == 10
    stored = {int(r["page"]): bytes(r["payload"]) for r in out if r["record_type"] == "response"}
    assert all(stored[i] == (t or "").encode() for i, _, t, _, _ in rows_of_pages() if i in stored)


def archive(count, gz, seed=0):
    rng = random.Random(seed)
    parts = []
    for i in range(count):
        p = rng.randbytes(rng.randrange(200, 3000))
        data = warc.record_bytes(str(i), f"http://h/{i}", p, hashlib.sha256(p).hexdigest(), len(p), None, "1970-01-01T00:00:00Z")
        if gz:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = z.compress(data) + z.flush()
        parts.append(data)
    return parts


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_recovers_all_sound_records_and_logs_the_gaps(gz):
    parts = archive(120, gz)
    hurt = {0, 7, 8, 60, 119}
    data = bytearray()
    spans = {}
    for i, p in enumerate(parts):
        if i in hurt:
            spans[i] = (len(data), len(p))
            p = p[:-40] + bytes(b ^ 0x55 for b in p[-40:])
        data += p
    reader = warc.SalvageReader(io.BytesIO(b"#junk#" + data))
    got = [int(r.headers["x-page-id"]) for r in reader]
    assert got == [i for i in range(120) if i not in hurt]
    lost = sum(size for _, size in reader.gaps)
    assert lost == 6 + sum(size for _, size in spans.values())
    assert [at for at, _ in reader.gaps] == [0, 6 + spans[7][0], 6 + spans[60][0], 6 + spans[119][0]]


def test_salvage_of_cut_and_empty_files():
    parts = archive(5, True)
    whole = b"".join(parts)
    reader = warc.SalvageReader(io.BytesIO(whole[:-10]))
    assert len(list(reader)) == 4 and reader.gaps == [(len(whole) - len(parts[-1]), len(parts[-1]) - 10)]
    assert list(warc.SalvageReader(io.BytesIO(b""))) == []
    reader = warc.SalvageReader(io.BytesIO(b"no archive at all"))
    assert list(reader) == [] and reader.gaps == [(0, 17)]


def read_back(data):
    reader = warc.SalvageReader(io.BytesIO(data))
    return [int(r.headers["x-page-id"]) for r in reader], reader


def member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@pytest.mark.parametrize("hurt", [0, 4, 9])
def test_damaged_record_in_a_member_of_several(hurt):
    parts = archive(10, False)
    bad = bytearray(parts[hurt])
    bad[-20] ^= 0x55
    data = b"".join([*parts[:hurt], bytes(bad), *parts[hurt + 1 :]])
    got, reader = read_back(b"junk" + member(data) + member(archive(12, False, 1)[11]))
    assert got == [*[i for i in range(10) if i != hurt], 11]
    assert reader.gaps == [(0, 4)] and reader.inner_gaps == [(4, sum(map(len, parts[:hurt])), len(bad))]


def test_cut_and_broken_members_keep_the_records_before():
    parts = archive(10, False)
    zipped, after = member(b"".join(parts)), member(archive(12, False, 1)[11])
    assert read_back(zipped[: len(zipped) // 2])[0] == list(range(len(read_back(zipped[: len(zipped) // 2])[0])))
    half, reader = read_back(zipped[: len(zipped) // 2])
    assert 3 <= len(half) <= 7 and reader.gaps == [] and len(reader.inner_gaps) == 1
    bad_sum = zipped[:-6] + bytes([zipped[-6] ^ 1]) + zipped[-5:]
    got, reader = read_back(bad_sum + after)
    assert got == [*range(10), 11]
    assert sum(n for _, n in reader.gaps) <= 8 and reader.inner_gaps == []
    got, reader = read_back(zipped[: len(zipped) // 2] + after)  # the next member starts inside the lost one
    assert got[:3] == [0, 1, 2] and set(range(10)) | {11} >= set(got)


def test_bad_byte_in_a_member_loses_no_record_before_it():
    texts = [(f"word{i} " * 400).encode() for i in range(50)]
    parts = [warc.record_bytes(str(i), "u", p, hashlib.sha256(p).hexdigest(), len(p), None, "d") for i, p in enumerate(texts)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    pieces = [z.compress(p) + z.flush(zlib.Z_FULL_FLUSH) for p in parts] + [z.flush()]
    at = sum(map(len, pieces[:30]))
    data = b"".join(pieces)
    got, reader = read_back(data[:at] + b"\xff" * 4 + data[at + 4 :] + member(parts[0]))
    assert got == [*range(30), 0] and reader.gaps


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("length", [b"99999999", b"99999999999999", b"5", b"9" * 40, b"-1"])
def test_wrong_lengths_lose_one_record(gz, length):
    parts = archive(30, False)
    cut = parts[7].index(b"Content-Length: ") + 16
    parts[7] = parts[7][:cut] + length + parts[7][parts[7].index(b"\r\n", cut) :]
    data = b"".join(parts)
    got, reader = read_back(member(data) if gz else data)
    assert got == [i for i in range(30) if i != 7]
    assert [g[-1] for g in (reader.inner_gaps if gz else reader.gaps)] == [len(parts[7])]


@pytest.mark.parametrize("gz", [True, False])
def test_long_blocks_are_read_and_time_is_linear(gz, monkeypatch):
    monkeypatch.setattr(warc, "LONG_BLOCK", 1000)
    monkeypatch.setattr(warc, "CHUNK", 4096)
    big = random.Random(1).randbytes(200_000)
    parts = [warc.record_bytes(str(i), "u", big[i:], hashlib.sha256(big[i:]).hexdigest(), len(big) - i, None, "d") for i in range(3)]
    data = b"".join(parts)
    assert read_back(member(data) if gz else data)[0] == [0, 1, 2]
    hurt = [p.replace(b"Content-Length: ", b"Content-Length: 9") for p in archive(3000, False)]
    start = time.time()
    got, reader = read_back((member(b"".join(hurt) + parts[1])) if gz else b"".join(hurt) + parts[1])
    assert got == [1] and time.time() - start < 20


def test_ids_with_line_breaks_stay_in_their_header(spark):
    df = spark.createDataFrame([("a\r\nX: 1", "u", "t" * 200), ("b", "u", "t" * 200)], "page_id string, url string, html string")
    out = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(df).collect()}
    assert out == {"a\r\nX: 1": ("response", None), "b": ("revisit", "a\r\nX: 1")}


def test_gaps_of_members_are_rows(spark, tmp_path):
    parts = archive(4, False)
    bad = parts[1][:-20] + b"?" * 20
    (tmp_path / "a.warc.gz").write_bytes(member(parts[0] + bad + parts[2]) + b"tail")
    out = warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "file string")).collect()
    assert [(r["page"], r["inner_offset"]) for r in out if not r["gap"]] == [("0", 0), ("2", len(parts[0]) + len(bad))]
    assert sorted((r["inner_offset"] or -1, r["bytes"]) for r in out if r["gap"]) == [(-1, 4), (len(parts[0]), len(bad))]


# ---- preferences ----


def test_pairs_share_their_prompt_and_mask_other_roles(spark):
    rows = [
        (0, 0, "system", "be kind"), (0, 1, "user", "hi <|end|>"), (0, 2, "assistant", "good"), (0, 3, "user", "ok"), (0, 4, "assistant", "bye"),
        (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>"), (1, 2, "assistant", "bad"),
        (2, 0, "user", "same"), (3, 5, "user", "same"), (3, 6, "assistant", "more"),
        (4, 0, "user", None), (5, 0, None, None), (6, 0, "user", "alone"), (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, side string, id int")
    out = {r["pair_id"]: r for r in preferences.format_preferences(df, F.expr("id div 2"), F.col("id") % 2 == 0).collect()}
    assert set(out) == {0, 1, 2}
    one = out[0]
    assert one["prompt_turns"] == 2 and one["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi < |end|><|end|>\n"
    assert one["rejected"] == "<|assistant|>\nbad<|end|>\n"
    spans = [one["chosen"][s["start"] : s["start"] + s["length"]] for s in one["chosen_spans"]]
    assert spans == ["good<|end|>\n", "bye<|end|>\n"]
    assert (out[1]["prompt_turns"], out[1]["chosen"], out[1]["chosen_spans"]) == (1, "", [])
    assert out[2]["prompt_turns"] == 0 and out[2]["rejected"] == "<||>\n<|end|>\n"
    assert preferences.format_preferences(df.limit(0), F.col("id"), F.lit(True)).collect() == []
