import pytest

from medallion.functions.names import (nice_case, normalize_field, rename_columns, renamed,
                                       silver_name)


def test_silver_name_deletes_spaces_brackets_and_maps_dash():
    assert silver_name("Slum Population - Total (2011)") == "SlumPopulation_Total2011"
    assert silver_name("Ward No.") == "WardNo."


def test_nice_case_upper_first_letter_keeps_rest():
    assert nice_case("No. Of Recognised Slums") == "NoOfRecognisedSlums"
    assert nice_case("literacy rate (percentage)") == "LiteracyRatePercentage"
    assert nice_case("ConsumptionofElectricityinlakhunits_TotalConsumption") == \
        "ConsumptionofElectricityinlakhunitsTotalConsumption"
    assert nice_case("a b", sep="_") == "A_B"


def test_nice_case_all_symbols_falls_back_to_col_n():          # D15
    assert renamed(["***", "x"], nice_case) == ["Col0", "X"]


def test_normalize_field_chains_steps():                         # D10
    assert normalize_field("  Région   Name ") == "region name"
    assert normalize_field("Balance (€)") == "balance"
    assert normalize_field("Nation.Key") == "nationkey"


def test_rename_collision_raises(spark):                         # D14
    df = spark.createDataFrame([(1, 2)], ["a b", "ab"])
    with pytest.raises(ValueError, match="collide"):
        rename_columns(df, silver_name)
