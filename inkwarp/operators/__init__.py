"""inkwarp.operators"""
