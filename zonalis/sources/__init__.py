"""Synthetic identities and samples, measurement sets, and status files."""

from zonalis.sources.identities import IdentityConfig, curriculum, identities_of, line_samples, random_identities, sample_stream, samples_of
from zonalis.sources.measurement import load_measurement_set
from zonalis.sources.status import StatusWriter, read_status, stream_status

__all__ = ["IdentityConfig", "StatusWriter", "curriculum", "identities_of", "line_samples", "load_measurement_set", "random_identities", "read_status", "sample_stream", "samples_of", "stream_status"]
