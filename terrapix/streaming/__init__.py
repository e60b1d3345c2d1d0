"""Streaming form of the stateless observation stage (see ``observations``)."""

from terrapix.streaming.observations import RAW_OBS_SCHEMA, ingest_observations, observation_stream

__all__ = ["RAW_OBS_SCHEMA", "ingest_observations", "observation_stream"]
