"""inkwarp.sources"""
