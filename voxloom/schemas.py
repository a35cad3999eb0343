"""Column layouts of the text formats (Spark DDL) and of the tables kept as Parquet."""

#: Ground truth TSV by number of columns.
GT_COLUMNS = {
    6: "speaker string, lang string, start string, end string, filename string, rnd_idx string",
    5: "speaker string, lang string, start string, end string, extra string",
    4: "speaker string, lang string, start string, end string",
    3: "start string, end string, speaker string",
}
#: Hypothesis files by name of the system (R3); `keep` lists the tags that count.
HYPOTHESES = {
    "whisper": {"ddl": "source string, lang string, start string, stop string, text string, prob string"},
    "aws": {"ddl": "fname string, source string, lang string, start string, stop string, text string, prob string"},
    "azure": {"ddl": "source string, start string, stop string, text string, prob string"},
    "speechbrain": {"ddl": "id string, start string, stop string, tag string", "keep": ["SPEECH"]},
    "audiotok": {"ddl": "id string, start string, stop string"},
    "ina": {"ddl": "tag string, start string, stop string", "keep": ["male", "female"]},
}
AZURE = "speaker_id string, start string, end string, transcript string, confidence string, language string"
VAD = "rec string, start string, stop string"
HUMAN_EDITS = "SampleIndex string, SpeakerLP string, StartTime string, EndTime string, ClusterPred string"
LP_RESULTS = "merged_unique_id string, gt_label int, hdbscan_label int, hdbscan_prob double, lp_label string, lp_confidence double, human_label string"
DETECTIONS = "wav string, start double, end double, pred int, conf double"
TRIALS = "label int, enroll string, test string"
SPEAKERS = "map<string, struct<speakers: array<struct<speaker_name: string, speaker_number: string, image_64: string>>>>"
CHUNKS = "rec_id string, speaker string, start_ms bigint, stop_ms bigint"
SEGMENTS = "merged_id bigint, merged_unique_id string, rec_id string, cluster_label int, gt_label int, prob double, start_ms bigint, end_ms bigint, n_constituents int, constituent_ids array<string>"
EDGES = "i bigint, j bigint, w double"
