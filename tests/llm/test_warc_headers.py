"""Headers of any length, and records that are damaged."""

import gzip

import pytest

from holdfast.llm import warc


def test_long_urls_are_read_back(tmp_path):
    path = tmp_path / "a.warc.gz"
    url = "http://a/" + "語" * 120_000
    path.write_bytes(b"".join(warc._member(i, u, "text", "372ea08cab33e71c02c651dbc83a474d32c676ea", None, "d") + b"\0"
                              for i, u in enumerate([url, "http://b/"])))
    found = [warc.parsed(content, "here", True) for _, content in warc.members(f"file:{path}", 0, 10**8)]
    assert [f[1] for f in found] == ["urn:x-page:0", "urn:x-page:1"] and [f[6] for f in found] == [b"text"] * 2
    assert len(found[0][2]) > 1_000_000


def test_a_record_without_the_end_of_its_header_is_an_error(tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: metadata\r\n"))
    with pytest.raises(ValueError, match="no end of its header"):
        list(warc.members(f"file:{path}", 0, 10**6))
