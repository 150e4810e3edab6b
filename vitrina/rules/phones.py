"""Public numbering-plan facts for the supported markets."""

from __future__ import annotations

from typing import NamedTuple


class PhonePlan(NamedTuple):
    country: str
    calling_code: str
    min_len: int
    max_len: int
    trunk: str
    valid: str
    groups: str  # how a national number is printed, digits per group


# --- fixed values: numbering plans -----------------------------------------------------------
PHONE_PLANS = [
    PhonePlan("ES", "34", 9, 9, "", r"^[5-9]\d{8}$", "3-2-2-2"),
    PhonePlan("PT", "351", 9, 9, "", r"^[2-9]\d{8}$", "3-3-3"),
    PhonePlan("FR", "33", 9, 9, "0", r"^[1-9]\d{8}$", "1-2-2-2-2"),
    PhonePlan("GB", "44", 9, 10, "0", r"^[1-9]\d{8,9}$", "4-6"),
    PhonePlan("DE", "49", 6, 11, "0", r"^[1-9]\d{5,10}$", "3-8"),
    PhonePlan("IT", "39", 6, 11, "", r"^[03]\d{5,10}$", "3-8"),
    PhonePlan("US", "1", 10, 10, "1", r"^[2-9]\d{2}[2-9]\d{6}$", "3-3-4"),
    PhonePlan("MX", "52", 10, 10, "", r"^[1-9]\d{9}$", "2-4-4"),
    PhonePlan("AR", "54", 10, 11, "0", r"^[1-9]\d{9,10}$", "2-4-5"),
    PhonePlan("CO", "57", 10, 10, "", r"^[36]\d{9}$", "3-7"),
    PhonePlan("CL", "56", 9, 9, "", r"^[2-9]\d{8}$", "1-4-4"),
    PhonePlan("PE", "51", 8, 9, "0", r"^[1-9]\d{7,8}$", "3-3-3"),
]
# --- end of fixed values ---------------------------------------------------------------------
