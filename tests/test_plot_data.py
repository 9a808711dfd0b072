"""Frames behind the plots of targets."""

import pytest

from relscope.plans.analyzer import Analyzer


def test_plot_data_of_targets(spark):
    rows = [("A" if k < 40 else "B", ("P", "Q")[k // 40], float(k), 3.0 * k + k % 3, str(k % 2), str(k // 2 % 2), float((k % 2 + k // 2 % 2) % 2 * 10 + k % 5)) for k in range(80)]
    d = spark.createDataFrame(rows, "left string, right string, amount double, other double, one string, two string, mixed double")
    a = Analyzer().fit_column_relationships(d).fit_super_sub(d).fit_multivariate(d, "mixed")
    found = a.plot_data(d, ["amount", "left", "mixed"], multivariates=True)
    letters = {r.level: r for r in found["numcat", "amount", "left"]["letter_values"].where("depth = 0").collect()}
    assert letters["A"].low == 19.5 and letters["B"].n == 40
    assert found["numnum", "amount", "other"]["line"].first().n == 80
    assert ("left", "right") in [k[1:] for k in found if k[0] == "catcat"] and any(k[0] == "super_sub" for k in found)
    assert {r.level for r in found["combination", "mixed", "one", "two"]["letter_values"].collect()} and len([k for k in found if k[0] == "combination"]) == 1
    box = a.plot_data(d, "amount", plot="box")["numcat", "amount", "left"]["quartiles"].orderBy("level").first()
    assert box.quantiles == [0.0, 9.75, 19.5, 29.25, 39.0]
    violin = a.plot_data(d, "amount", plot="violin")["numcat", "amount", "left"]["density"]
    assert violin.count() == 200
    with pytest.raises(ValueError):
        a.plot_data(d, "amount", plot="pie")
    with pytest.raises(RuntimeError):
        Analyzer().plot_data(d, "amount", auto_fit=False)
