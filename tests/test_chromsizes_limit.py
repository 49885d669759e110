import pytest

from tessella.functions import coords
from tessella.sources import text


def test_more_segments_than_the_limit_raise(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(coords, "SEGMENT_LIMIT", 3)
    (tmp_path / "three").write_text("a\t1\nb\t2\nc\t3\n")
    (tmp_path / "four").write_text("a\t1\nb\t2\nc\t3\nd\t4\n")
    assert text.read_chromsizes(spark, str(tmp_path / "three")).count() == 3
    with pytest.raises(ValueError):
        text.read_chromsizes(spark, str(tmp_path / "four"))
