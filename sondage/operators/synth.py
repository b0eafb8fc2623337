"""Synthetic tables by index arithmetic, their CSV text and digests (SRC11, SRC12, SNK1, SNK7, SNK11, WN6, WN7, WN10, SF25-SF27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns and value lists of the two tables.
AIRLINES = (
    "passport customer_name customer_surname flight_number flight_date seat_number airline_code airline_name airport_departure departure_name departure_location departure_city "
    "airport_arrival arrival_name arrival_location arrival_city belt_number license_number airplane_model status_code status status_date status_hour crew_license crew_role"
).split()
MANUFACTURING = "client_id client_name n_order date n_material description_material n_operation description_operation workcenter_id order_operation_id timestamp quantity".split()
STATUSES = (("SCH", "Scheduled"), ("BRD", "Boarding"), ("DEP", "Departed"), ("ARR", "Arrived"), ("DLY", "Delayed"))
SEAT_LETTERS = "ABCDEF"

# One row a flight: everything that a flight's bookings share.
FLIGHTS = """
SELECT i, 12 + i % 2 AS bookings, 2 + i % 2 AS n_statuses, 3 + i % 3 AS n_crew, mix, dep, arr,
  format_string('FL%03d', i % 20 + 1) AS flight_number, date_add(DATE '2026-01-01', CAST(mix % 40 AS INT)) AS day,
  (i + 3 * (i DIV 20)) % 10 + 1 AS airline, 2 * arr - (i DIV 2) % 2 AS belt, (i * 7 + 13 * (i DIV 20)) % 25 + 1 AS plane,
  CASE WHEN i >= 39 AND mix % 40 = (i - 39 + (i - 39) DIV 20) % 40 THEN i - 39 END AS partner
FROM (SELECT *, (mix + 3 + 5 * (i % 2)) % 15 + 1 AS arr, mix % 15 + 1 AS dep FROM (SELECT id AS i, id + id DIV 20 AS mix FROM range(80)))
"""

# One row a booking. A second flight of a day repeats, in its last booking, the first passenger of its partner.
BOOKINGS = f"""
SELECT *, (CASE WHEN partner IS NOT NULL AND j = bookings - 1 THEN 12 * partner + partner DIV 2 ELSE booking END) * 7 % 250 + 1 AS pax, booking * 11 % 30 AS seat,
  (i + j % n_statuses) % 5 AS status, j % n_crew AS turn
FROM (SELECT *, 12 * i + i DIV 2 + j AS booking FROM (SELECT *, explode(sequence(0L, bookings - 1)) AS j FROM ({FLIGHTS})))
"""

AIRLINES_SQL = f"""
SELECT booking AS row_idx, format_string('P%05d', pax) AS passport, concat('Name', (pax - 1) % 80 + 1) AS customer_name, concat('Surname', (pax - 1) % 60 + 1) AS customer_surname,
  flight_number, CAST(day AS STRING) AS flight_date, concat(seat DIV 6 + 1, substr('{SEAT_LETTERS}', CAST(seat % 6 AS INT) + 1, 1)) AS seat_number,
  format_string('AL%02d', airline) AS airline_code, format_string('Airline_%02d', airline) AS airline_name,
  format_string('AP%02d', dep) AS airport_departure, format_string('Airport_%02d', dep) AS departure_name, format_string('L%02d', (dep - 1) % 10 + 1) AS departure_location, format_string('City_%02d', (dep - 1) % 10 + 1) AS departure_city,
  format_string('AP%02d', arr) AS airport_arrival, format_string('Airport_%02d', arr) AS arrival_name, format_string('L%02d', (arr - 1) % 10 + 1) AS arrival_location, format_string('City_%02d', (arr - 1) % 10 + 1) AS arrival_city,
  format_string('B%02d', belt) AS belt_number, format_string('REG%03d', plane) AS license_number, concat('Model_', (plane - 1) % 5 + 1) AS airplane_model,
  {{codes}}[status] AS status_code, {{labels}}[status] AS status,
  CAST(CASE WHEN {{codes}}[status] IN ('ARR', 'DLY') THEN date_add(day, 1) ELSE day END AS STRING) AS status_date,
  format_string('%02d:00', 6 + (i + (j % n_statuses) * 2) % 12) AS status_hour,
  format_string('C%04d', crew) AS crew_license, CASE WHEN crew <= 10 THEN 'Pilot' WHEN crew <= 20 THEN 'CoPilot' WHEN crew <= 30 THEN 'CabinCrew' ELSE 'Purser' END AS crew_role
FROM (SELECT *, CASE turn WHEN 0 THEN mix % 10 + 1 WHEN 1 THEN mix % 10 + 11 ELSE (i * 2 + turn - 2) % 20 + 21 END AS crew FROM ({BOOKINGS}))
""".replace("{codes}", "array(" + ", ".join(f"'{c}'" for c, _ in STATUSES) + ")").replace("{labels}", "array(" + ", ".join(f"'{s}'" for _, s in STATUSES) + ")")

MANUFACTURING_SQL = """
SELECT row_idx, client AS client_id, format_string('Client_%02d', client) AS client_name, i AS n_order, CAST(day AS STRING) AS date,
  material AS n_material, format_string('Material_%02d', material) AS description_material, operation AS n_operation, format_string('Operation_%02d', operation) AS description_operation,
  workcenter AS workcenter_id, row_idx + 1 AS order_operation_id, concat(CAST(day AS STRING), format_string(' 08:%02d:00', 15 * (j - 1))) AS timestamp, quantity
FROM (
  SELECT i, j, (i - 1) * 4 + j - 1 AS row_idx, date_add(DATE '2026-01-01', CAST((i - 1) % 120 AS INT)) AS day,
    CASE WHEN i > 240 THEN (i - 241) % 40 + 1 ELSE (i - 1 + 3 * ((i - 1) DIV 120)) % 40 + 1 END AS client,
    CASE WHEN i > 120 AND j = 1 THEN (i - 121) % 25 + 1 ELSE (i + 5 * (CASE WHEN (i + i DIV 120) % 6 = 0 THEN least(j, 3) ELSE j END - 1) - 1) % 25 + 1 END AS material,
    CASE WHEN (i + i DIV 120) % 5 = 0 THEN least(j, 3) ELSE j END AS operation,
    (i + CASE WHEN i % 7 = 0 THEN least(j, 3) ELSE j END - 2) % 8 + 1 AS workcenter,
    25.0D * ((q + CASE WHEN q % 5 = 0 THEN least(j, 3L) ELSE j END) % 8 + 1) AS quantity
  FROM (SELECT *, k + k DIV 120 AS q FROM (SELECT o.id AS i, p.id AS j, CASE WHEN o.id > 240 THEN o.id - 240 ELSE o.id END AS k FROM range(1, 251) o CROSS JOIN range(1, 5) p)))
"""


def airlines(spark: SparkSession) -> DataFrame:
    """SRC11: 1000 bookings of 80 flights; ``row_idx`` is the order."""
    return spark.sql(AIRLINES_SQL)


def manufacturing(spark: SparkSession) -> DataFrame:
    """SRC12: 1000 operations of 250 orders; ``row_idx`` is the order."""
    return spark.sql(MANUFACTURING_SQL)


def csv_text(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """SNK1: one row with the table as CSV text (for tables that fit in one value)."""
    line = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in columns])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n")
    return df.agg(F.concat(F.lit(",".join(columns) + "\n"), body, F.lit("\n")).alias("text"))


def build_all(spark: SparkSession) -> DataFrame:
    """SNK7, SNK11: (name, text, sha256) of both tables."""
    parts = (("airlines.csv", airlines(spark), AIRLINES), ("manufacturing.csv", manufacturing(spark), MANUFACTURING))
    made = [csv_text(df, columns, "row_idx").select(F.lit(name).alias("name"), "text", F.sha2("text", 256).alias("sha256")) for name, df, columns in parts]
    return made[0].unionByName(made[1])
