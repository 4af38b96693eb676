"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

EVENT = "struct<t_ms:bigint,time:string,event:string,severity:string,confidence:float>"
VIDEO_INFO = "struct<duration_ms:bigint,fps:double,width:int,height:int,size_bytes:bigint,codec:string>"
CATALOG = f"id string, original_name string, object_key string, info {VIDEO_INFO}, uploaded_at timestamp"
GROUND_TRUTH = f"video string, duration_ms bigint, notes string, events array<{EVENT}>"
MOTION_SAMPLE = "video_id bigint, idx bigint, t_ms bigint, score float, raw float, is_scene_cut boolean, dhash bigint, grid array<smallint>, cell_peak float"
ANALYSIS_FRAME = "video_id bigint, idx bigint, t_ms bigint, width int, height int, data binary"
WINDOW_SCORES = "video_id bigint, w bigint, class_index int, score float"
CLASS_LABELS = "class_index int, mid string, display_name string"
TRANSLATIONS = "display_name string, display_name_tr string"
CLIP = "t0_ms bigint, t1_ms bigint, object_key string, duration_ms bigint, time_scale float, service_frames bigint, effective_fps double"
INGESTED = "schema_version int, video_id string, object_key string, duration_ms bigint, fps double, width int, height int, size_bytes bigint, codec string, ingested_at timestamp"
TOOL_REQUEST = "schema_version int, video_id string, tool string, payload string"
PCM = "video_id bigint, samples array<float>"
