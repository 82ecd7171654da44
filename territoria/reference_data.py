"""Fixed values of the domain: codes, names, weights, bands and definitions of ratios."""

from __future__ import annotations

#: Official region codes and names of metropolitan France (fixed values).
REGIONS = {"11": "Île-de-France", "24": "Centre-Val de Loire", "27": "Bourgogne-Franche-Comté", "28": "Normandie", "32": "Hauts-de-France", "44": "Grand Est", "52": "Pays de la Loire", "53": "Bretagne", "75": "Nouvelle-Aquitaine", "76": "Occitanie", "84": "Auvergne-Rhône-Alpes", "93": "Provence-Alpes-Côte d'Azur", "94": "Corse"}
#: Metropolitan departments: 01 to 95, Corsica as 2A and 2B.
DEPARTMENTS = [f"{k:02d}" for k in range(1, 96) if k != 20] + ["2A", "2B"]
#: French months (fixed values), without accents.
MONTHS = {"janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12}
#: Indicators of the composite score: weight and direction (fixed values), and the floor of coverage.
SCORE_MODEL = [("dossiers_per_1000", 0.30, "positive"), ("unemployment_rate", 0.20, "positive"), ("poverty_rate", 0.20, "positive"), ("median_income", 0.15, "negative"), ("mean_debt", 0.10, "positive"), ("inflation", 0.05, "positive")]
COVERAGE_FLOOR = 0.60
#: Risk bands [from, to) on the score (fixed values).
BANDS = [("very_low", 0.0, 20.0), ("low", 20.0, 40.0), ("moderate", 40.0, 60.0), ("high", 60.0, 80.0), ("very_high", 80.0, 100.0000001)]
#: Weight scenarios of the sensitivity analysis, in the order of SCORE_MODEL (fixed values).
SCENARIOS = {"baseline": [0.30, 0.20, 0.20, 0.15, 0.10, 0.05], "equal": [1 / 6] * 6, "dossier_heavy": [0.45, 0.15, 0.15, 0.10, 0.10, 0.05]}
#: Accented letters and what they fold to, place by place (fixed values).
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
