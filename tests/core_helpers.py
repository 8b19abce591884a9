"""What the tests of the core share."""

INSTANCE = "https://lg.example/"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
