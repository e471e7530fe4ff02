"""Schemas of the tables that the operators exchange, as DDL."""

DETECTIONS = (
    "video string, frame_index int, time double, x1 int, y1 int, x2 int, y2 int, confidence double, label string, "
    "blur_var double, num_eyes int, frontal double, landmarks array<array<double>>, crop_id string"
)
FRAMES = "video string, frame_index int, time double, is_cut boolean"
TRACKS = "video string, track_id int, label string, start_time double, end_time double, num_detections int, character_id int"
CUTS = "video string, cut double"
VIDEOS = "video string, duration double"
DIFFERENCES = "video string, i int, j int, diff double"
WINDOW_SCAN = "video string, k long, t double, n long"
SEGMENTS = "video string, k long, start double, end double, character_count long, raw_start double"
