"""Operator 1: every field and record against a plain Python version."""

import hashlib
import re
from datetime import datetime

from pyspark.sql import functions as F

from saleslattice.llm import warc

ODD = [
    (1, "http://a/", "HTTP/1.1 200 OK\r\nDate: Tue, 05 Mar 2024 10:11:12 GMT\r\nX: y\r\n\r\n<title>é &amp; ü</title><p>one<p>two<!-- gone"),
    (2, None, None), (3, "  ", ""), (None, "u", "a &#65;&#x42;&#x1F600; &#0; &#1114112; &#55296; &# &#12 &#39;&lt;"),
    (4, "u", "<nav>" * 3 + "lost"), (5, "u", "<head><title>T<body>kept</body>"), (6, "u", "<script>x</script >y<style>z"),
    (7, "u", "<<b>i</b> 1 < 2 > 0 <"), (8, "u", "HTTP/1.0 404 No\r\nDate: today\r\n\r\n"), (9, "u", "<nav>" * 30_000), (10, "u", "<!--" * 30_000), (11, "u", "x " * 200_000),
    (12, "u", "a  b<br>  c\r\n\r\n\r\nd<BR/>"), (12, "u", "a  b<br>  c\r\n\r\n\r\nd<BR/>"), (14, " http://a/\r\nX-Evil: 1 \x7f", "<title>two\n lines &amp; &#13;\u2028more</title>"), (15, "\r\n\t", "HTTP/1.1 200 OK\r\nLong: a\r\n  b\r\nno header\r\nX:\x01y\r\n\r\nbody"),
    (13, "u", "<a href=1><A class=x HREF = '2'><a name=q>"),
]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def uuid(*parts):
    h = sha("\n".join(parts))
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def entity(m):
    n = int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])
    return chr(n) if 0 < n < 0xD800 or 0xE000 <= n < 0x110000 else m[0]


def text_of(html):
    t = re.sub(r"(?s)<!--.*?(?:-->|\Z)", "", html)
    t = re.sub(r"(?si)<head\b[^<>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)", "", t)
    t = re.sub(r"(?si)<(script|style|nav|noscript)\b[^<>]*>.*?(?:</\1\s*>|\Z)", "", t)
    t = re.sub(r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|footer|header)\b[^<>]*>", "\n", t)
    t = re.sub(r"&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", entity, re.sub(r"<[^<>]*>", "", t))
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = t.replace(a, b)
    t = re.sub(r" ?\n[ \n]*", "\n", re.sub("[ \t\r ]+", " ", t))
    return t.strip("\n ")


def folded(x):
    return re.sub(r"[\x00-\x1f\x7f]", "", re.sub("[ \t\n\x0b\f\r\x85\u2028\u2029]+", " ", x)).strip(" ")


def named(t):
    t = re.sub(r"&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", entity, t)
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = t.replace(a, b)
    return t


def fields_of(head):
    out = ""
    for i, x in enumerate(x for x in re.split(r"\r?\n|\r", re.sub(r"\r?\n[ \t]+", " ", head)) if x.strip(" ")):
        x = folded(x)
        out += ("source-status: " if i == 0 else "source-" if re.match(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+:", x) else "source-line: ") + x + "\r\n"
    return out


def brute(page_id, url, html):
    url, html = re.sub(r"[\x00-\x1f\x7f]", "", url or "").strip(" ").replace(" ", "%20") or None, html or ""
    head, mark, payload = html.partition("\r\n\r\n")
    if html.startswith("HTTP/") and mark:
        head += "\r\n"
    else:
        payload, head = html, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n"
    date = re.search(r"(?im)^Date: (?:\w+, )?(\d+ \w+ \d+ [\d:]+) GMT", head)
    date = datetime.strptime(date[1], "%d %b %Y %H:%M:%S").strftime("%Y-%m-%dT%H:%M:%SZ") if date else warc.DATE
    source = uuid("response", "-" if page_id is None else str(page_id), url or "-", sha(payload))
    text = text_of(payload)
    title = re.search(r"(?si)<title\b[^<>]*>(.*?)(?:</title|\Z)", payload)
    meta = f"title: {folded(named(title[1])) if title else ''}\r\noutlinks: {len(re.findall(r'(?i)<a\b[^>]*\bhref\s*=', payload))}\r\ntext-length: {len(text.encode())}\r\n"
    meta += fields_of(head)
    for kind, mime, block in (("conversion", "text/plain", text), ("metadata", "application/warc-fields", meta)):
        id_ = uuid(kind, source)
        lines = [("WARC-Type", kind), ("WARC-Record-ID", id_), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Block-Digest", f"sha256:{sha(block)}"), ("WARC-Source-Payload-Digest", f"sha256:{sha(payload)}"), ("Content-Type", mime), ("Content-Length", len(block.encode()))]
        record = ("WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in lines if b is not None) + "\r\n" + block + "\r\n\r\n").encode()
        yield page_id, kind, id_, source, url, date, f"sha256:{sha(payload)}", f"sha256:{sha(head + chr(13) + chr(10) + payload)}", f"sha256:{sha(block)}", head, len(block.encode()), len(record), sha(record)


def test_against_brute_force(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame(ODD, "page_id long, url string, html string")
    odd.unionByName(pages).withColumns({"text": F.lit(1), "block": F.lit("x"), "record": F.lit(2.0), "head": F.lit("y")}).write.parquet(f"{tmp_path}/pages.parquet")
    rows = [tuple(r) for r in odd.collect() + pages.collect()]
    got = sorted(map(tuple, warc.op1_warc_derivatives(spark, str(tmp_path)).collect()), key=str)
    want = sorted((x for r in rows for x in brute(*r)), key=str)
    assert len(got) == 2 * len(rows)
    for a, b in zip(got, want, strict=True):
        assert a == b
    assert warc.as_records(warc.derive(odd.limit(0))).count() == 0


def parsed(record):
    """A record by a reader of its own: version, headers by name, block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    pairs = [x.split(": ", 1) for x in lines]
    names = [n for n, _ in pairs]
    assert version == "WARC/1.1" and len(names) == len(set(names)) and all(re.fullmatch("[A-Za-z-]+", n) for n in names)
    headers = dict(pairs)
    n = int(headers["Content-Length"])
    assert rest[n:] == b"\r\n\r\n"
    return headers, rest[:n]


def test_records_can_be_read_back(spark):
    odd = spark.createDataFrame(ODD, "page_id long, url string, html string")
    rows = warc.as_records(warc.derive(odd)).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        headers, block = parsed(bytes(r.record))
        assert "X-Evil" not in headers and headers["WARC-Type"] == r.record_type and headers["WARC-Refers-To"] == r.refers_to
        assert headers["WARC-Block-Digest"] == f"sha256:{sha(block)}" and headers.get("WARC-Target-URI") == r.target_uri
        if r.record_type == "metadata":
            lines = block.decode().split("\r\n")
            assert lines[-1] == "" and all(re.match("[^\\s:]+:", x) and not re.search("[\\x00-\\x1f]", x) for x in lines[:-1]), lines
