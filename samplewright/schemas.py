"""Explicit schemas of the tables that the library reads and writes."""

POPULATION = "id string, lon double, lat double, x array<double>, y double, split string"
ASSIGNMENT = "id string, kind string, value string"
UNIT_COST = "unit string, cost double"
SIMILARITY = "row_id string, col_id string, sim double"
SAMPLE = "run_id string, id string"
STATUS = "id string, status string"
METRICS = "run_id string, dataset string, init_set string, cost_type string, method string, budget string, seed string, phase string, metric string, value double"
METRIC_JSON = "r2 double, mse double, rmse double, mae double, _corrupt string"
