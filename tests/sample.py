"""Small source snapshots: three dates, six companies, five assets, with gaps, returns and renamed companies."""

from __future__ import annotations

import csv
from pathlib import Path

from ledgerloom.sources.snapshots import FAMILIES

# The dates, companies, assets, shares and the gap of the sample, on which the expected tallies depend.
DATES = ("2025-01-01", "2025-06-01", "2025-09-01")
# code: number, country, name on the first date, name later
COMPANIES = {
    "SGH": (1, "GB", "Severn Grid Holdings plc", "Severn Grid Holdings PLC"),
    "SRI": (2, "ES", "Soleada Renovables Iberia", "Soleada Renovables Iberia"),
    "NCU": (3, "US", "North Cape Utilities Inc", "North Cape Utilities Incorporated"),
    "NCS": (4, "US", "North Cape Storage LLC", "North Cape Storage LLC"),
    "RIP": (5, "DE", "Rhein Infra Partners GmbH", "Rhein Infra Partners GmbH"),
    "CWC": (6, "FR", "Centrale Val Clair SA", "Centrale Val Clair SA"),
}
ASSETS = {
    "AST-001": ("Llano Solar", "ES", "solar", "150", "SRI"),
    "AST-002": ("Ridge Wind", "US", "wind", "220", "NCU"),
    "AST-003": ("Elbe Storage", "DE", "storage", "90", "RIP"),
    "AST-004": ("Clair Solar", "FR", "solar", "35", "CWC"),
    "AST-005": ("Moor Wind", "GB", "wind", "120", "SGH"),
}
OWNED = {
    "2025-01-01": [("AST-001", "SGH", "100"), ("AST-002", "NCU", "75"), ("AST-002", "RIP", "25"), ("AST-003", "RIP", "60"), ("AST-003", "NCS", "40"), ("AST-004", "CWC", "100")],
    "2025-06-01": [("AST-001", "SGH", "100"), ("AST-002", "NCU", "60"), ("AST-002", "RIP", "40"), ("AST-003", "RIP", "100"), ("AST-005", "SGH", "80"), ("AST-005", "RIP", "20")],
    "2025-09-01": [("AST-001", "SGH", "100"), ("AST-002", "NCU", "75"), ("AST-002", "RIP", "25"), ("AST-003", "RIP", "60"), ("AST-003", "NCS", "40"), ("AST-005", "SGH", "80"), ("AST-005", "RIP", "20")],
}
SHORT = {"SGH": "Severn Grid Hldgs PLC", "NCU": "North Cape Util. Inc"}


def _name(code: str, date: str) -> str:
    return COMPANIES[code][2 if date == DATES[0] else 3]


def _ids(code: str) -> dict[str, str]:
    number, country = COMPANIES[code][:2]
    return {"country_code": country, "registry_entity_id": f"REG-{number:03d}", "lei": f"LEI-{code}-{number:03d}", "source_entity_id": f"SRC-{code}"}


def write_samples(root: Path) -> Path:
    for date in DATES:
        stamp = date.replace("-", "")
        registry = [
            {"source_record_id": f"REG{_ids(c)['registry_entity_id'][-3:]}-{stamp}", "source_business_key": _ids(c)["registry_entity_id"], "record_type": "registry", "entity_name": _name(c, date), "entity_type": "company"}
            | {k: v for k, v in _ids(c).items() if k != "source_entity_id"}
            for c in COMPANIES
        ]
        hierarchy = []
        for n, (parent, child) in enumerate([("SGH", "SRI"), ("NCU", "NCS")], 1):
            row = {"source_record_id": f"HIER{n:03d}-{stamp}", "source_business_key": f"{parent}>{child}", "record_type": "hierarchy", "entity_name": _name(child, date), "country_code": COMPANIES[child][1]}
            for side, code in (("parent", parent), ("child", child)):
                row |= {f"{side}_name": _name(code, date)} | {f"{side}_{k}": v for k, v in _ids(code).items()}
            hierarchy.append(row)
        infra, count = [], {}
        for asset, owner, pct in OWNED[date]:
            count[asset] = count.get(asset, 0) + 1
            name, country, sector, capacity, operator = ASSETS[asset]
            row = {
                "source_record_id": f"ASSET{asset[-3:]}{'AB'[count[asset] - 1]}-{stamp}", "source_business_key": f"{asset}|{owner}", "record_type": "asset", "entity_name": name,
                "country_code": country, "asset_source_id": asset, "asset_name": name, "asset_country": country, "asset_sector": sector, "capacity_mw": capacity, "ownership_pct": pct,
            }
            for side, code in (("owner", owner), ("operator", operator)):
                shown = SHORT.get(code, _name(code, date)) if side == "owner" and date == DATES[0] else _name(code, date)
                row |= {f"{side}_name": shown} | {f"{side}_{k}": v for k, v in _ids(code).items() if k != "registry_entity_id"}
            infra.append(row)
        for family, rows in (("registry_entities", registry), ("entity_hierarchy", hierarchy), ("infrastructure_assets", infra)):
            path = root / family / f"{date}.csv"
            path.parent.mkdir(parents=True, exist_ok=True)
            with path.open("w", newline="", encoding="utf-8") as file:
                writer = csv.DictWriter(file, FAMILIES[family])
                writer.writeheader()
                writer.writerows(rows)
    return root


def write_dimensions(root: Path) -> Path:
    root.mkdir(parents=True, exist_ok=True)
    (root / "country_attributes.csv").write_text(
        "country_code,country_name,latitude_centroid,longitude_centroid,altitude_avg_m,territorial_type,economic_level,gdp_tier,solar_irradiance_kwh_m2_yr,wind_speed_avg_ms,regulatory_stability_score\n"
        "ES,Spain,39.5,-3.2,610,inland,upper_middle,3,1800,4.2,7\n"
        "FI,Finland,63.1,26.4,140,inland,high,2,870,6.1,10\n"
        "GB,United Kingdom,52.7,-1.4,125,island,high,4,990,7.2,7\n"
        "KE,Kenya,0.4,37.9,1180,mixed,lower_middle,1,2100,3.9,5\n"
        "US,United States,41.3,-101.8,820,coastal,high,5,1540,6.4,7\n"
    )
    (root / "sector_lifecycle.csv").write_text(
        "sector,typical_lifespan_years,min_lifespan_years,max_lifespan_years,construction_years,decommissioning_years,base_capacity_factor,irradiance_sensitivity,wind_sensitivity,altitude_sensitivity,"
        "economic_level_bonus_high,economic_level_bonus_upper_middle,economic_level_bonus_lower_middle,economic_level_bonus_low,training_weight\n"
        "solar,24,16,31,1,1,0.21,0.00012,0.0,0.00001,0.015,0.005,0.0,-0.005,0.3\n"
        "storage,13,9,18,2,1,0.38,0.0,0.0,0.0,0.025,0.015,0.005,-0.02,0.3\n"
        "wind,21,15,27,2,1,0.29,0.0,0.025,0.00002,0.01,0.005,0.0,-0.015,0.4\n"
    )
    return root
