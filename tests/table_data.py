"""Names shared by the table tests."""
SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def ids(df, col="id"):
    return sorted(r[col] for r in df.select(col).collect())


#: Rows of the ``crates`` fixture: nulls in every column but the first, ties in weight.
CRATES = [
    (104, "sealed", 31.5), (87, "open", None), (12, None, 4.0), (55, "sealed", 4.0), (230, "lost", -1.25), (61, "open", 31.5), (9, None, None),
]
CRATE_DDL = "code bigint, state string, kilos double"
