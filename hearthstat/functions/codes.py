"""Fixed values of the survey files: code lists, kept as text with leading zeros."""

from __future__ import annotations


def code_range(first: int, last: int, width: int = 2) -> list[str]:
    """Consecutive numeric codes as zero-padded text."""
    return [str(code).zfill(width) for code in range(first, last + 1)]


# Answer codes.
YES = "1"
NO = "2"
NO_ACCESS = "3"

# Veteran period of service, Hispanic origin, school grade K-12, household with a member aged 65+.
VETERAN_PERIODS = code_range(1, 14)
HISPANIC_ORIGINS = code_range(2, 24)
SCHOOL_GRADES_K12 = code_range(2, 14)
SENIOR_PRESENT = ["1", "2"]

# State names and postal codes (50 states; territories and the federal district have no entry).
STATE_POSTAL_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO",
    "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA",
    "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV",
    "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX",
    "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV",
    "Wisconsin": "WI", "Wyoming": "WY",
}
