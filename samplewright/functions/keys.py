"""Keys, names and cells: string functions in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of second-level districts and their canonical forms.
DISTRICTS = {
    "tandjouare": "tandjoare",
    "binah": "bimah",
    "centre": "centrale",
    "tchaoudjo": "tchaudjo",
    "mo": "plaine du mo",
}

# State names by two-digit FIPS code.
STATES = {
    "01": "Alabama", "02": "Alaska", "04": "Arizona", "05": "Arkansas", "06": "California", "08": "Colorado",
    "09": "Connecticut", "10": "Delaware", "11": "District of Columbia", "12": "Florida", "13": "Georgia",
    "15": "Hawaii", "16": "Idaho", "17": "Illinois", "18": "Indiana", "19": "Iowa", "20": "Kansas",
    "21": "Kentucky", "22": "Louisiana", "23": "Maine", "24": "Maryland", "25": "Massachusetts",
    "26": "Michigan", "27": "Minnesota", "28": "Mississippi", "29": "Missouri", "30": "Montana",
    "31": "Nebraska", "32": "Nevada", "33": "New Hampshire", "34": "New Jersey", "35": "New Mexico",
    "36": "New York", "37": "North Carolina", "38": "North Dakota", "39": "Ohio", "40": "Oklahoma",
    "41": "Oregon", "42": "Pennsylvania", "44": "Rhode Island", "45": "South Carolina", "46": "South Dakota",
    "47": "Tennessee", "48": "Texas", "49": "Utah", "50": "Vermont", "51": "Virginia", "53": "Washington",
    "54": "West Virginia", "55": "Wisconsin", "56": "Wyoming",
}

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def composite_key(*cols: Column) -> Column:
    """Columns as strings joined by '_'; null becomes 'None'."""
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])


def normalize_admin(name: Column) -> Column:
    """Without accents, lower case, trimmed, then the canonical spelling."""
    plain = F.trim(F.lower(F.translate(name, ACCENTED, PLAIN)))
    return F.coalesce(_map(DISTRICTS)[plain], plain)


def county_key(name: Column, state_fips: Column, county_fips: Column) -> Column:
    """name_county_state_fips with codes padded to 2 and 3 digits; an unknown state is 'None'."""
    state = F.lpad(state_fips.cast("string"), 2, "0")
    county = F.lpad(county_fips.cast("string"), 3, "0")
    return F.concat_ws("_", name, county, F.coalesce(_map(STATES)[state], F.lit("None")), state)


def split_shrid(shrid: Column) -> tuple[Column, Column, Column]:
    """(state, district, district_id) of 'x-state-district-...'."""
    parts = F.split(shrid, "-")
    state, district = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return state, district, F.concat(state, F.lit("-"), district)


def tile_id(name: Column) -> Column:
    """The id in 'tile_<id>.tif'."""
    return F.regexp_replace(F.regexp_replace(name, "^tile_", ""), r"\.tif$", "")


def format_cell(mean: Column, err: Column) -> Column:
    """'m.mm ± s.ss', or '--' when either is null."""
    return F.when(mean.isNull() | err.isNull(), "--").otherwise(F.format_string("%.2f ± %.2f", mean, err))


def run_key(init_set: Column, cost: Column, method: Column, group_type: Column, budget: Column, lam: Column, seed: Column, optimised: Column) -> Column:
    """Path of a run: init set, cost, 'opt' for optimised methods, method, group type, budget, lambda (poprisk only), seed; nulls are left out."""
    of_lambda = F.when(method.startswith("poprisk"), F.concat(F.lit("util_lambda_"), lam.cast("string")))
    return F.concat_ws(
        "/", init_set, cost, F.when(optimised, "opt"), method, group_type, F.concat(F.lit("budget_"), budget.cast("string")), of_lambda, F.concat(F.lit("seed_"), seed.cast("string"))
    )
