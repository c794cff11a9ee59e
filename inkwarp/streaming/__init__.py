"""inkwarp.streaming"""
