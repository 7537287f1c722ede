"""Explicit schemas of the inputs. Codes are text, so leading zeros survive."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

HOUSEHOLDS = _struct(
    state_id=_S, puma20_id=_S, puma10_id=_S, serialno=_S, wgtp=_L, np=_I, fs=_S, accessinet=_S, hispeed=_S,
    othsvcex=_S, dialup=_S, satellite=_S, hincp=_D, r65=_S,
)
PERSONS = _struct(
    puma20_id=_S, puma10_id=_S, serialno=_S, sporder=_I, pwgtp=_L, povpip=_I, hins4=_S, pap=_D, ssip=_D,
    vps=_S, racblk=_S, hisp=_S, schg=_S,
)
AREA_TO_DISTRICT = _struct(puma_id=_S, congress_id118=_S, allocation_factor=_D)
AREA_TO_ZIP = _struct(puma_id=_S, zipcode=_S, allocation_factor=_D)
ZIP_TO_RURAL = _struct(zip=_S, urban_rural_code=_S, allocation_factor=_D)
AREA_TO_TRACT = _struct(puma22_id=_S, tract_id=_S, allocation_factor=_D)
LOCATIONS = _struct(
    location_id=_S, block_fips=_S, served_by_copper_100_20=_I, served_by_coaxcable_100_20=_I,
    served_by_fiber_100_20=_I,
)
HIGH_COST_GROUPS = _struct(state_id=_S, high_cost_indicator=_S, total_households=_D)
ZIP_POPULATION = _struct(
    zip=_S, year=_I, total_hh_population=_L, total_black_or_african_am=_L, hispanic_or_latino_origin_any_race=_L,
)
ZIP_HOUSEHOLDS = _struct(zip=_S, year=_I, total_households=_L)
STATES = _struct(state_id=_S, geo_name=_S, total_households=_L, year=_I)
LEDGER = _struct(year=_I, committed=_L, available=_L)
MONTHLY_PROJECTION = _struct(months=_D, adoption_rate=_D, enrolled_hh=_D, cost=_D)

# CSV files whose headers hold spaces or empty names.
SUBSCRIBER_RECORDS = T.StructType([
    T.StructField("Support Year", _I),
    T.StructField("Support Month", _S),
    T.StructField("Support Month Date Format", _S),
    T.StructField("Subscriber Count", _L),
    T.StructField("Disbursement Amount", _D),
])
HIGH_COST_AREA_LIST = T.StructType([
    T.StructField("State FIPS", _S),
    T.StructField("State Name", _S),
    T.StructField("Census Block Group", _S),
    T.StructField("_c3", _S),
    T.StructField("_c4", _S),
])
