"""Feature specification and every fixed threshold of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the documented behaviour of the original
# tool for results to match; they are stated here once, in natural order.
# ---------------------------------------------------------------------------

#: The nine default features, canonical order.
DEFAULT_FEATURES: tuple[str, ...] = (
    "acousticness",
    "danceability",
    "energy",
    "instrumentalness",
    "liveness",
    "loudness",
    "speechiness",
    "tempo",
    "valence",
)
#: Features bounded to [0, 1]; logit-transformed before scaling.
DEFAULT_LOGIT: tuple[str, ...] = (
    "acousticness",
    "danceability",
    "energy",
    "instrumentalness",
    "liveness",
    "speechiness",
    "valence",
)
#: Features log-transformed before scaling.
DEFAULT_LOG: tuple[str, ...] = ("tempo",)
#: Identity columns of a track table.
TITLE, ARTIST, TRACK_ID = "title", "artist", "spotify_id"
DEFAULT_IDS: tuple[str, ...] = (TRACK_ID, TITLE, ARTIST)

LOGIT_EPSILON = 1e-3  # clip bounded values to [eps, 1 - eps] before logit
MAX_MISSING_PER_ROW = 3  # rows with strictly more missing features are dropped
FULL_COVARIANCE_MIN_ROWS = 50  # below this, GMM uses diagonal covariances
DELTA_BIC_THRESHOLD = 10.0  # "strong evidence" gap for the k choice
POSTERIOR_LOG_FLOOR = 1e-12  # clip before log in the ICL entropy term
GMM_N_INIT = 5
KMEANS_N_INIT = 10
DEFAULT_K_RANGE: tuple[int, ...] = tuple(range(2, 13))
EM_TOL = 1e-3  # change of mean log-likelihood per row
EM_MAX_ITER = 100
EM_REG_COVAR = 1e-6
KMEANS_TOL = 1e-4  # relative to the mean per-feature variance
KMEANS_MAX_ITER = 300

UNCLASSIFIED_LABEL = -1
UNCLASSIFIED_SUMMARY = "unclassified"
MIN_PLAYLIST_SIZE = 5
MAX_PLAYLIST_SHARE = 0.5
STABILITY_ARI_THRESHOLD = 0.7

NEAR_ZERO_Z_THRESHOLD = 0.5
MAX_FEATURES_IN_SUMMARY = 3
CORRELATION_DEDUP_THRESHOLD = 0.6
#: Feature -> (phrase for z >= 0, phrase for z < 0); others read "high X"/"low X".
QUALIFIER_OVERRIDES: dict[str, tuple[str, str]] = {
    "tempo": ("fast tempo", "slow tempo"),
    "loudness": ("loud", "quiet"),
}

#: Source CSV headers and the export layout.
SRC_TRACK_URI = "Track URI"
SRC_TRACK_NAME = "Track Name"
SRC_ARTIST_NAME = "Artist Name(s)"
TRACK_URI_PREFIX = "spotify:track:"
EXPORT_COLUMNS: tuple[str, ...] = (
    "Track URI",
    "Track Name",
    "Artist Name(s)",
    "Cluster",
    "Cluster Summary",
)
UNSAFE_NAME_CHARS = '/\\:*?"<>|'
UNCLASSIFIED_STEM = "Unclassified"
DEFAULT_COMBINED_STEM = "playlists"

#: Remote lookup: ids per request, retries, backoff base and cap (seconds).
LOOKUP_BATCH_SIZE = 40
MAX_RETRIES = 3
BACKOFF_BASE = 0.5
BACKOFF_CAP = 30.0
RETRY_STATUSES: tuple[int, ...] = (429, 500, 502, 503, 504)

PREVIEW_MAX_ROWS = 20


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns identify a row and how each feature is transformed.

    ``features`` fixes the canonical column order of the modelling matrix;
    every feature is in exactly one of logit / log / plain (the default).
    """

    features: tuple[str, ...] = DEFAULT_FEATURES
    logit: tuple[str, ...] = DEFAULT_LOGIT
    log: tuple[str, ...] = DEFAULT_LOG
    ids: tuple[str, ...] = DEFAULT_IDS
    max_missing: int = MAX_MISSING_PER_ROW
    epsilon: float = LOGIT_EPSILON
    qualifiers: dict = field(default_factory=lambda: dict(QUALIFIER_OVERRIDES))

    def __post_init__(self) -> None:
        unknown = (set(self.logit) | set(self.log)) - set(self.features)
        if unknown:
            raise ValueError(f"transform columns not in features: {sorted(unknown)}")
        if set(self.logit) & set(self.log):
            raise ValueError("a column cannot be both logit and log transformed")

    def transform_of(self, name: str) -> str:
        if name in self.logit:
            return "logit"
        if name in self.log:
            return "log"
        return "plain"

    @property
    def plain(self) -> tuple[str, ...]:
        return tuple(c for c in self.features if c not in self.logit and c not in self.log)


MUSIC = FeatureSpec()
