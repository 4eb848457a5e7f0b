from polynet.operators.feature_names import FEATURES
from polynet.operators.features import FAMILIES
from polynet.operators.rules import resolve
from polynet.sources.sinks import feature_catalogue


def test_every_published_name_resolves(spark):
    assert {k for k, _, _ in FEATURES} == {name for family in FAMILIES.values() for name in family()}
    for key, label, _ in FEATURES:
        for said in (key, label, label.upper(), f"  {label.replace(' ', '_')} ", label.replace("(deg)", ""), label.replace("(deg)", "degrees")):
            assert resolve(said) == key, said
    assert resolve("no such feature") is None and resolve(None) is None and resolve("Junction angle mean") == "junctionAngleAverageDegrees"
    assert feature_catalogue(spark).count() == 47
