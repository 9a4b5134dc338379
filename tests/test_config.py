"""Configuration: defaults, what is derived, and each refusal."""

from __future__ import annotations

import pytest

from eddyforge.config import build, default, describe, load
from eddyforge.errors import ConfigError

GOOD = {"files": {"output_csv": "x.csv"}}


def test_defaults():
    c = default()
    assert (c.period.averaging_minutes, c.period.closed, c.window_us) == (30.0, "right", 1_800_000_000)
    assert (c.lags["co2"].low, c.lags["co2"].high, c.lags["co2"].nominal) == (-40, 40, 0)
    assert c.effective == {"co2": "mixing_ratio", "h2o": "mixing_ratio"} and c.convert_cell == ()
    assert c.height == pytest.approx(3.0 - 1e-4)
    assert c.warnings


def test_lag_samples_round_half_to_even():
    c = default(period__acquisition_frequency=10, lag__co2_nominal_s=0.25, lag__co2_min_s=-0.15, lag__co2_max_s=0.35)
    assert (c.lags["co2"].nominal, c.lags["co2"].low, c.lags["co2"].high) == (2, -2, 4)


def test_displacement():
    assert default(site__canopy_height=3.0).displacement == pytest.approx(2.0)
    assert default(site__canopy_height=3.0, site__displacement_height=1.0).displacement == 1.0


def test_closed_path_density_is_converted():
    c = default(gases__co2_measure_type="molar_density", units__co2="mmol/m3", gases__analyser_path="closed", variables__t_cell="T", variables__p_cell="P")
    assert c.convert_cell == ("co2",) and not c.density("co2")


def test_mass_density_divides_by_molar_mass():
    c = default(gases__h2o_measure_type="molar_density", units__h2o="g/m3")
    assert c.maps["h2o"][0] == pytest.approx(1e-3 / 0.01802)


@pytest.mark.parametrize(
    "changes,says",
    [
        ({"site__colour": "red"}, "unknown key"),
        ({"nowhere__x": "1"}, "unknown section"),
        ({"site__latitude": None}, "is empty"),
        ({"site__latitude": "north"}, "not a number"),
        ({"site__latitude": 91}, "between -90 and 90"),
        ({"period__closed": "both"}, "choose one of"),
        ({"period__averaging_minutes": 0}, "positive whole"),
        ({"period__averaging_minutes": 12.5}, "positive whole"),
        ({"period__acquisition_frequency": 0}, "must be positive"),
        ({"period__min_samples": -1}, "not be negative"),
        ({"period__min_samples": "1.5"}, "not a whole number"),
        ({"units__co2": "mg/m3"}, "declared a mixing ratio"),
        ({"gases__co2_measure_type": "molar_density"}, "declared a molar density"),
        ({"site__pressure_pa": 99000}, "exactly one source of pressure"),
        ({"variables__p_air": None}, "exactly one source of pressure"),
        ({"variables__p_air": None, "site__pressure_pa": -1}, "must be positive"),
        ({"despike__q": 0}, "must be positive"),
        ({"despike__variables": "u,x"}, "known are"),
        ({"despike__variables": "u,u"}, "repeats"),
        ({"despike__variables": "u,t_cell"}, "known are"),
        ({"lag__scalars": "co2,t_cell"}, "known are"),
        ({"qc__steady_state_pair": "w,p_cell"}, "known are"),
        ({"despike__enabled": "maybe"}, "true or false"),
        ({"detrend__variables": "u,ta"}, "can't hold ta"),
        ({"qc__steady_state_pair": "w"}, "two names"),
        ({"lag__co2_min_s": 3}, "is above"),
        ({"spectral__enabled": "true"}, "must be positive when"),
        ({"files__header_line": 2}, "before files.first_data_line"),
        ({"files__delimiter": "ab"}, "not one character"),
        ({"output__float_format": "%q"}, "doesn't format"),
        ({"gases__co2_measure_type": "molar_density", "units__co2": "mmol/m3", "gases__analyser_path": "closed"}, "t_cell and variables.p_cell"),
        ({"variables__u": None}, "is empty"),
    ],
)
def test_refusals(changes, says):
    with pytest.raises(ConfigError, match=says):
        default(**changes)


def test_a_steady_state_pair_may_repeat_a_name():
    assert default(qc__steady_state_pair="w,w").qc.steady_state_pair == ("w", "w")


def test_a_cell_that_is_not_used_warns():
    assert any("t_cell" in w for w in default(variables__t_cell="T").warnings)
    used = default(gases__co2_measure_type="molar_density", units__co2="mmol/m3", gases__analyser_path="closed", variables__t_cell="T", variables__p_cell="P")
    assert not any("t_cell" in w for w in used.warnings)


def test_output_is_required():
    with pytest.raises(ConfigError, match="files.output_csv is required"):
        build({})


def test_load_file(tmp_path):
    p = tmp_path / "c.ini"
    p.write_text("[files]\noutput_csv = a.csv\ndelimiter = \\t ; a tab\n[period]\nclosed = LEFT\n[despike]\nenabled = off\n")
    c = load(str(p))
    assert (c.files.delimiter, c.period.closed, c.despike.enabled) == ("\t", "left", False)
    assert "period.closed = left" in describe(c) and "derived.window_us = 1800000000" in describe(c)
    p.write_text("[DEFAULT]\na = 1\n[files]\noutput_csv = a.csv\n")
    with pytest.raises(ConfigError, match="DEFAULT"):
        load(str(p))
    with pytest.raises(ConfigError):
        load(str(tmp_path / "none.ini"))
