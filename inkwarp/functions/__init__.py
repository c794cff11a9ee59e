"""inkwarp.functions"""
