"""Aerial-video analytics as Spark jobs: detections, tracks, events, frame documents."""
