from concurrent.futures import ThreadPoolExecutor

import pytest

from passagelake.sources import sessions as module
from passagelake.sources.sessions import Sessions
from passagelake.sources.shared import Conflict


def test_parallel_appends_get_turns_without_gaps(spark, tmp_path):
    path = str(tmp_path / "s")

    def talk(k: int) -> list[int]:
        mine, out = Sessions(spark, path), []
        for j in range(3):
            last = mine.append("shared", [("user", f"{k}-{j}-{m}") for m in range(1 + k % 3)])
            out.append((last, 1 + k % 3, f"{k}-{j}"))
        return out

    with ThreadPoolExecutor(6) as pool:
        told = [x for got in pool.map(talk, range(6)) for x in got]
    found = [(r["turn"], r["text"]) for r in Sessions(spark, path).load("shared").collect()]
    assert [t for t, _ in found] == list(range(sum(n for _, n, _ in told)))
    text = dict(found)
    for last, n, name in told:  # what an append wrote stands together, where it said
        assert [text[last - n + 1 + m] for m in range(n)] == [f"{name}-{m}" for m in range(n)]


def test_killed_writers_leave_nothing(spark, tmp_path, monkeypatch):
    s = Sessions(spark, str(tmp_path / "s"))
    assert s.messages().isEmpty() and s.load("a").isEmpty() and s.append("a", []) == -1
    with monkeypatch.context() as m:
        def die(*_):
            raise KeyboardInterrupt

        m.setattr(module, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            s.append("a", [("user", "lost")])
    assert s.load("a").isEmpty() and s.messages().isEmpty() and s.sweep(3600) == 0
    assert s.append("a", [("user", "one"), ("assistant", None)], "t") == 1 and s.append("b", [("user", "other")]) == 0
    assert s.sweep(-60) == 1 and [r["text"] for r in s.load("a").collect()] == ["one", None]
    # A claim without an entry holds others up until its lease is over.
    claim = f"{s._folder('a')}/log/{1:012}.claim"
    s._fs.create(s._path(claim), False).close()
    with pytest.raises(Conflict):
        module.publish(s._fs, s._path, claim[:-6], {})
    monkeypatch.setattr("passagelake.sources.shared.LEASE", -60)
    assert s.append("a", [("user", "two")]) == 2 and s.messages().count() == 4 and s.listing().count() == 2


def test_sessions_of_the_format_before_are_refused(spark, tmp_path):
    spark.createDataFrame([("a", 0)], "conv_id string, turn long").write.parquet(f"{tmp_path}/s/0123abcd")
    with pytest.raises(ValueError):
        Sessions(spark, f"{tmp_path}/s").messages()
