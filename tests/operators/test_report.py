import pytest
from textloom.sources import files


def test_longer_reports_raise(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_report(spark, spark.range(files.REPORT_ROWS + 1), str(tmp_path / "long"))
    assert len(files.write_report(spark, spark.range(files.REPORT_ROWS), str(tmp_path / "most"))["rows"]) == files.REPORT_ROWS
