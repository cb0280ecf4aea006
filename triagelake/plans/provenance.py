"""Where a ledger file comes from and whether what is made of it may be distributed: the manifests and their checks."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import SparkSession

from triagelake.plans.artifact import sha256_file
from triagelake.sources.ledger import CSV_HEADER, check_header

MANIFEST = "source-manifest-1"


def record_source_manifest(spark: SparkSession, path: str, retrieved_at: str, source_ref: str, about: dict) -> dict:
    """The manifest of a checked file; about holds provider, dataset, dataset_version, license and license_url."""
    datetime.fromisoformat(retrieved_at.replace("Z", "+00:00"))  # refuses what is no time
    check_header(spark, path)
    own = {"schema": MANIFEST, "verification_status": "verified", "retrieved_at": retrieved_at, "source_ref": source_ref}
    return {**about, **own, "source_file": os.path.basename(path), "source_sha256": sha256_file(path), "source_schema": CSV_HEADER.split(",")}


def validate_source(spark: SparkSession, path: str, manifest: dict, about: dict) -> str:
    """The file's digest, if the verified manifest describes this file, dataset and license; raises otherwise."""
    if manifest.get("verification_status") != "verified":
        raise ValueError("the source manifest is not verified")
    if manifest.get("source_file") != os.path.basename(path) or any(manifest.get(k) != v for k, v in about.items()):
        raise ValueError("the source manifest describes another source")
    digest = sha256_file(path)
    if manifest.get("source_sha256") != digest:
        raise ValueError("the source's digest is not the manifest's")
    check_header(spark, path)
    return digest


def validate_distribution(decision: dict, digest: str, about: dict) -> None:
    """Raises unless the decision approves distribution of what is made of this very source."""
    if decision.get("public_distribution_status") != "approved":
        raise ValueError("distribution is not approved")
    if any(decision.get(k) != about.get(k) for k in ("dataset_version", "license")):
        raise ValueError("the approval covers another dataset or license")
    if decision.get("approved_source_sha256") != digest:
        raise ValueError("the approval covers another source file")
