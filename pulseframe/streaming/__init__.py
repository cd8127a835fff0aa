"""Operators that keep no state, so a streaming DataFrame of events can pass through unchanged."""

from pulseframe.operators.clean import apply_value_selectors, convert_units, map_code_to_variable
from pulseframe.operators.scalers import zscore_inverse, zscore_transform

STATELESS = (convert_units, apply_value_selectors, map_code_to_variable, zscore_transform, zscore_inverse)
