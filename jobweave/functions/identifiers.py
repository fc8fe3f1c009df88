"""Compact identifiers (``prefix:local``) to full identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.coerce import col
from jobweave.functions.names import code_lookup

LOCAL_NAMESPACE = "https://jobweave.local/ontology#"

# Published namespaces; ``dd`` is the local one and configurable.
NAMESPACES = {
    "dcat": "http://www.w3.org/ns/dcat#",
    "prov": "http://www.w3.org/ns/prov#",
    "dqv": "http://www.w3.org/ns/dqv#",
    "org": "http://www.w3.org/ns/org#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "dprod": "https://ekgf.github.io/dprod#",
    "swo": "http://www.ebi.ac.uk/swo/",
    "obi": "http://purl.obolibrary.org/obo/",
    "iao": "http://purl.obolibrary.org/obo/",
    "ol": "https://openlineage.io/spec/",
    "dd": LOCAL_NAMESPACE,
}


def expand_identifier(c: Column | str, namespaces: dict[str, str] | None = None) -> Column:
    """Full identifier; NULL when there is no colon or the prefix is unknown."""
    text = col(c)
    colon = F.instr(text, ":")
    base = code_lookup(F.substring_index(text, ":", 1), namespaces or NAMESPACES)
    return F.when(colon > 0, F.concat(base, text.substr(colon + 1, F.length(text))))


def identifier_error(c: Column | str, namespaces: dict[str, str] | None = None) -> Column:
    """Why an identifier cannot be expanded, or NULL."""
    text = col(c)
    return F.when(
        text.isNull() | (F.instr(text, ":") == 0), F.lit("not a compact identifier")
    ).when(expand_identifier(text, namespaces).isNull(), F.lit("unknown prefix"))


def split_identifiers(
    df: DataFrame, column: str, namespaces: dict[str, str] | None = None, into: str = "iri"
) -> tuple[DataFrame, DataFrame]:
    """Rows with an expanded identifier, and the rest with the reason."""
    marked = df.withColumns(
        {into: expand_identifier(column, namespaces), "_why": identifier_error(column, namespaces)}
    )
    good = marked.filter(F.col("_why").isNull()).drop("_why")
    bad = marked.filter(F.col("_why").isNotNull()).drop(into).withColumnRenamed("_why", "error")
    return good, bad
