"""Record layouts and schema contracts. Positions and names are fixed values of the published file formats."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    """A slice [start, end) of a fixed-width line, or a column of a delimited file."""

    name: str
    start: int = 0
    end: int = 0
    kind: str = "string"
    nullable: bool = True
    places: int | None = None


@dataclass(frozen=True)
class Contract:
    dataset: str
    fields: tuple[Field, ...]
    keys: tuple[str, ...]
    min_length: int = 0
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def alignment(self, columns: list[str]) -> list[str]:
        """Fields that a table lacks."""
        return [f.name for f in self.fields if f.name not in columns]


def _f(name, start, end, kind="string", places=None):
    return Field(name, start, end, kind, places=places)


RVU = Contract(
    "pprrvu",
    (
        _f("hcpcs", 0, 5), _f("modifier", 5, 7), _f("description", 7, 57), _f("status_code", 57, 58), _f("rvu_work", 61, 65, "double", 2), _f("rvu_pe_nonfac", 68, 72, "double", 2), _f("rvu_pe_fac", 77, 81, "double", 2), _f("rvu_malp", 85, 89, "double", 2),
        _f("opps_cap_applicable", 91, 92), _f("na_indicator", 92, 93), _f("bilateral_ind", 103, 104), _f("multiple_proc_ind", 104, 105), _f("assistant_surg_ind", 105, 106), _f("co_surg_ind", 106, 107), _f("team_surg_ind", 107, 108), _f("endoscopic_base", 108, 109), _f("conversion_factor", 133, 138, "double", 4),
        _f("global_days", 140, 143), _f("physician_supervision", 144, 146), _f("diag_imaging_family", 147, 148), _f("total_nonfac", 153, 157, "double", 2), _f("total_fac", 160, 164, "double", 2),
    ),
    ("hcpcs", "modifier", "effective_from"),
    165,
)
GPCI = Contract("gpci", (_f("mac", 0, 5), _f("state", 16, 18), _f("locality_code", 24, 26), _f("locality_name", 28, 78), _f("gpci_work", 121, 126, "double", 3), _f("gpci_pe", 133, 138, "double", 3), _f("gpci_mp", 145, 150, "double", 3)), ("locality_code", "effective_from"), 150)
LOCALITY = Contract("locality", (_f("mac", 0, 12), _f("locality_code", 12, 18), _f("state_name", 18, 50), _f("fee_area", 50, 120), _f("county_names", 120, 1000)), ("mac", "locality_code"), 20)
ZIP9 = Contract("zip9", (_f("state", 0, 2), _f("zip5", 2, 7), _f("carrier", 7, 12), _f("locality", 12, 14), _f("rural_flag", 14, 15), _f("plus4_flag", 20, 21), _f("plus4", 21, 25)), ("zip9_low", "zip9_high", "effective_from"), 25)
CONVERSION_FACTOR = Contract("conversion_factor", (Field("cf_type"), Field("cf_value", kind="double", places=4), Field("cf_description"), Field("effective_from", kind="date"), Field("effective_to", kind="date")), ("cf_type", "effective_from"), domains={"cf_type": ("physician", "anesthesia")})
ADDENDUM_A = Contract("addendum_a", (Field("apc"), Field("group_title"), Field("status_indicator"), Field("relative_weight", kind="double", places=4), Field("rate", kind="double", places=2)), ("apc", "effective_from"), domains={"status_indicator": tuple("ABCDEFGHJKLMNPQRSTUVWXYZ")})
ADDENDUM_B = Contract("addendum_b", (Field("hcpcs"), Field("modifier"), Field("short_descriptor"), Field("status_indicator"), Field("apc"), Field("relative_weight", kind="double", places=4), Field("rate", kind="double", places=2)), ("hcpcs", "modifier", "effective_from"))
#: Header names of the addenda and the columns they mean.
ADDENDUM_NAMES = {"hcpcs_code": "hcpcs", "si": "status_indicator", "payment_rate": "rate", "apc_code": "apc"}

LAYOUTS: dict[tuple[str, str], Contract] = {("pprrvu", "2025"): RVU, ("gpci", "2025"): GPCI, ("locality", "2025"): LOCALITY, ("zip9", "2025"): ZIP9}

#: File names and the data sets they hold; the first pattern that matches at the start wins.
ROUTES = (("pprrvu", r"pprrvu"), ("gpci", r"gpci"), ("oppscap", r"oppscap"), ("anes", r"anes"), ("locality", r"\d\dlocco|locco|locality"), ("conversion_factor", r"(?:cf|conversion)[_-]?"), ("zip9", r"zip9"), ("zip_locality", r"zip5|zplc"), ("addendum_a", r".*addendum[_ -]?a"), ("addendum_b", r".*addendum[_ -]?b"))


def precisions(contract: Contract, default: int = 6) -> dict[str, int]:
    """Decimals of each number of a contract, for its content hash."""
    return {f.name: default if f.places is None else f.places for f in contract.fields if f.kind == "double"}


def layout(dataset: str, year: int, quarter: str | None = None) -> Contract | None:
    """The layout of a quarter, or else that of the whole year."""
    return LAYOUTS.get((dataset, f"{year}{quarter}")) or LAYOUTS.get((dataset, str(year)))
