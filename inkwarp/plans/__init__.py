"""inkwarp.plans"""
