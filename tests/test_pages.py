"""Paged pulls over recorded pages: what is asked for, what is written, and where a restart goes on."""

from pathlib import Path

import pytest

from siftstone.sources import pages
from siftstone.sources.model import Limits, Refused


def logged(folder: str, log: str, broken: int = -1, shy: bool = False):
    """A maker of clients that write down each page they are asked for; they refuse `broken`, and every page's first call if `shy`."""

    class Logged(pages.RecordedPages):
        def page(self, number):
            asked = Path(log) / str(number)
            before = asked.read_text() if asked.exists() else ""
            asked.write_text(before + "x")
            if number == broken:
                raise Refused(404)
            if shy and not before:
                raise Refused(429, wait=0.0)
            return pages.RecordedPages.page(self, number)

    return lambda: Logged(folder)


@pytest.fixture
def feed(tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "log").mkdir()

    def grow(first, end):
        for n in range(first, end):
            lines = [] if n % 5 == 3 else [f"record {n}.{k} é" for k in range(n % 4 + 1)]
            (tmp_path / "feed" / f"part-{n:05}").write_text("".join(x + "\n" for x in lines))

    return tmp_path, grow


def want(n):
    return [(p, k, f"record {p}.{k} é") for p in range(n) if p % 5 != 3 for k in range(p % 4 + 1)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def asked(tmp_path):
    return {int(f.name): len(f.read_text()) for f in (tmp_path / "log").iterdir()}


def test_read_once(spark, feed):
    at, grow = feed
    grow(0, 14)
    folder, log = str(at / "feed"), str(at / "log")
    assert rows(pages.read(spark, logged(folder, log, shy=True), Limits(tasks=3, at_once=2))) == want(14)
    assert set(asked(at)) == set(range(14))


def test_a_grown_feed_is_asked_for_its_new_pages_only(spark, feed):
    at, grow = feed
    folder, log, into = str(at / "feed"), str(at / "log"), str(at / "into")
    client = logged(folder, log)
    assert rows(pages.pull(spark, client, into, Limits(tasks=2))) == []
    grow(0, 9)  # the last page is empty, so that its place is known by its row of nulls
    assert rows(pages.pull(spark, client, into, Limits(tasks=2), window=4)) == want(9)
    assert rows(pages.pull(spark, client, into, Limits(tasks=2), window=3)) == want(9)
    grow(9, 12)
    assert rows(pages.pull(spark, client, into, Limits(tasks=2), window=50)) == want(12)
    assert asked(at) == {n: 1 for n in range(12)}


@pytest.mark.parametrize("window", [2, 5, 50])
def test_a_restart_goes_on_at_the_window_that_failed(spark, feed, window):
    at, grow = feed
    grow(0, 12)
    folder, log, into = str(at / "feed"), str(at / "log"), str(at / "into")
    with pytest.raises(Exception, match="page 8"):
        pages.pull(spark, logged(folder, log, broken=8), into, Limits(tasks=2), window=5)
    assert rows(pages.stored(spark, into).where("position IS NOT NULL")) == want(5)
    assert rows(pages.pull(spark, logged(folder, log), into, Limits(tasks=2), window=window)) == want(12)
    times = asked(at)
    assert all(times[n] == 1 for n in (*range(5), 10, 11))
    assert times[8] > 1


def test_pages_are_dealt_in_turn():
    parts = pages.stretches(3, 10, 3)
    assert sorted(n for p in parts for n in range(p.first, p.end, p.step)) == list(range(3, 10))
    assert len(pages.stretches(4, 4, 8)) == 1
